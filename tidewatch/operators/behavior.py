"""User behaviour, sentiment by group and aspect, brands, alerts, digests, and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import FEW_WORDS, containing, is_question, sentiment, signed
from tidewatch.operators.scoring import round_up_tie
from tidewatch.runtime import dealt, maybe_broadcast, written
from tidewatch.sources.tables import ago, ts


#: Groups of one keyword that meet all its subscribers in one task; users of one keyword in a list.
KEYWORD_PART, LIST = 256, 1024


def behavior_stats(events: DataFrame, as_of, days: int = 30, top: int = 10) -> DataFrame:
    """Per user in long form (user_id, kind, name, cnt): events by meta.category, in total, and the ``top`` actions."""
    rows = events.filter((F.col("created_at") > ago(as_of, days * 86400)) & F.col("user_id").isNotNull())
    category = F.get_json_object("meta", "$.category")
    by = rows.filter(F.col("action").isin("click", "page_view", "scrape")).withColumn("name", category).filter("name is not null").groupBy("user_id", "name").agg(F.count(F.lit(1)).alias("cnt")).withColumn("kind", F.lit("category"))
    actions = rows.groupBy("user_id", F.col("action").alias("name")).agg(F.count(F.lit(1)).alias("cnt"))
    total = actions.groupBy("user_id").agg(F.sum("cnt").alias("cnt")).withColumns({"kind": F.lit("total"), "name": F.lit("events")})
    best = actions.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("cnt"), "name"))).filter(F.col("r") <= top).drop("r").withColumn("kind", F.lit("action"))
    return by.unionByName(total).unionByName(best).select("user_id", "kind", "name", "cnt")


def suggested_weights(stats: DataFrame) -> DataFrame:
    """user, category and round(.5 + 1.5 cnt / max, 2) from the category rows of :func:`behavior_stats`."""
    rows = stats.filter("kind = 'category'").withColumn("m", F.max("cnt").over(Window.partitionBy("user_id"))).filter("m > 0")
    return rows.select("user_id", F.col("name").alias("category"), round_up_tie(0.5 + 1.5 * F.col("cnt") / F.col("m"), 2).alias("weight"))


def apply_weights(current: DataFrame, suggested: DataFrame) -> DataFrame:
    """Upsert per user: suggested weights as a map where there are any, the locale ratio kept, .5 by default.
    ``current``: user_id, category_weights, locale_ratio."""
    new = suggested.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "weight")))).alias("_w"))
    rows = current.join(new, "user_id", "full_outer")
    return rows.select("user_id", F.coalesce("_w", "category_weights").alias("category_weights"), F.coalesce("locale_ratio", F.lit(0.5)).alias("locale_ratio"))


def sentiment_distribution(articles: DataFrame, newest: int = 200) -> DataFrame:
    """group and how many of its ``newest`` texts (title and body[:200]) are positive, neutral, negative."""
    w = Window.partitionBy("group_id").orderBy(F.desc("publish_time"), "article_id")
    rows = articles.filter("group_id is not null").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= newest)
    rows = sentiment(rows.withColumn("_t", F.concat_ws(" ", "title", F.substring("body", 1, 200))), "_t")
    return rows.groupBy("group_id").agg(*[F.count(F.when(F.col("label") == s, 1)).alias(s) for s in ("positive", "neutral", "negative")], F.count(F.lit(1)).alias("total"))


def aspect_sentiment(articles: DataFrame, groups: DataFrame, k: int = 8, newest: int = 50, sentences: int = 30) -> DataFrame:
    """group, aspect (one of its first ``k`` keywords) and the labels of up to ``sentences`` sentences that contain it."""
    w = Window.partitionBy("group_id").orderBy(F.desc("publish_time"), "article_id")
    rows = articles.filter("group_id is not null").withColumn("a", F.row_number().over(w)).filter(F.col("a") <= newest)
    parts = F.transform(F.split(F.concat_ws("\n", "title", "body"), r"[.!?\n]+"), lambda s: F.substring(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), 1, 512))
    aspects = groups.select(F.col("id").alias("group_id"), F.slice("keywords", 1, k).alias("k"))
    rows = rows.join(aspects, "group_id").select("group_id", "a", "k", F.posexplode(parts).alias("s", "sentence")).filter("sentence <> ''")
    hits = rows.select("group_id", "a", "s", "sentence", F.explode(F.filter("k", lambda x: F.lower("sentence").contains(F.lower(x)))).alias("aspect"))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("group_id", "aspect").orderBy("a", "s"))).filter(F.col("r") <= sentences)
    out = sentiment(hits, "sentence").groupBy("group_id", "aspect").agg(*[F.count(F.when(F.col("label") == s, 1)).alias(s) for s in ("positive", "neutral", "negative")], F.count(F.lit(1)).alias("total"))
    return out.filter("total > 0")


def brand_baseline(brands: DataFrame, sns: DataFrame, as_of, newest: int = 200) -> DataFrame:
    """brand id, mean and population deviation of its ``newest`` signals of a day, signed min(1, abs(z) / 5)."""
    sets = written(brands.select("id", F.array_sort(F.array_distinct(F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.array("brand_name")))).alias("_set")), "brand-sets")
    words = sets.select("_set").distinct().select("_set", F.explode("_set").alias("keyword"))
    posts = sns.filter(F.col("snapshot_at") >= ago(as_of, 86400)).select(F.col("id").alias("post"), "keyword", "burst_z", "sentiment_badge", "snapshot_at")
    w = Window.partitionBy("_set").orderBy(F.desc("snapshot_at"), "post")
    # brands with equal keywords share their figures; the newest of each keyword are enough for the newest of each brand
    each = posts.withColumn("_k", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("snapshot_at"), "post"))).filter(F.col("_k") <= newest)
    rows = words.join(each, "keyword").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= newest)
    size = F.least(F.lit(1.0), F.abs(F.coalesce("burst_z", F.lit(0.0))) / 5)
    value = F.when(F.col("sentiment_badge") == "positive", size).when(F.col("sentiment_badge") == "negative", -size).otherwise(0.0)
    n = written(rows.groupBy("_set").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")), "brand-figures")
    return sets.join(maybe_broadcast(n, 300), "_set", "left").select("id", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"))


def _labelled(rows: DataFrame, current, threshold: float) -> DataFrame:
    flat = F.abs("std") < 1e-12
    z = F.when(flat, 0.0).otherwise((current - F.col("mean")) / F.when(flat, 1.0).otherwise(F.col("std")))
    return rows.withColumn("z_score", z).withColumn("label", F.when(F.col("z_score") < -threshold, "crisis").when(F.col("z_score") > threshold, "surge").otherwise("normal"))


def brand_monitor(brands: DataFrame, mentions: DataFrame, sns: DataFrame, as_of, threshold: float = 2.0) -> DataFrame:
    """brand, mean signed sentiment of its mentions (brand_id, text), baseline, z and label."""
    now = sentiment(mentions).groupBy(F.col("brand_id").alias("id")).agg(F.avg(signed()).alias("current"), F.count(F.lit(1)).alias("mentions"))
    rows = brand_baseline(brands, sns, as_of).join(now, "id", "left").withColumns({"current": F.coalesce("current", F.lit(0.0)), "mentions": F.coalesce("mentions", F.lit(0))})
    return _labelled(rows, F.col("current"), threshold)


def brand_alerts(brands: DataFrame, sns: DataFrame, as_of, threshold: float = 2.0) -> DataFrame:
    """Active brands not alerted within a day whose baseline says crisis or surge against 0, or is flat below -.3."""
    due = brands.filter(F.col("is_active") & (F.col("last_alerted_at").isNull() | (F.col("last_alerted_at") <= ago(as_of, 86400))))
    rows = _labelled(brand_baseline(due, sns, as_of), F.lit(0.0), threshold)
    rows = rows.withColumn("label", F.when((F.abs("std") < 1e-12) & (F.col("mean") < -0.3), "crisis").otherwise(F.col("label"))).filter("label <> 'normal'")
    return due.select("id", "user_id", "brand_name").join(rows, "id")


def surge_users(subs: DataFrame) -> DataFrame:
    """user_id and k, the keywords (lower case) of which each user subscribed surges; written."""
    return written(subs.filter("alert_surge and keyword is not null").select("user_id", F.lower("keyword").alias("k")).distinct(), "surge-wanted")


def surge_words(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """group_id and k, each keyword of a group that somebody of ``wanted`` subscribed, as often as the group comes."""
    words = groups.select(F.col("id").alias("group_id"), F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("k"))
    return words.join(maybe_broadcast(written(wanted.select("k").distinct(), "surge-keywords"), 60), "k", "left_semi").select("group_id", "k")


def in_lists(rows: DataFrame, value: str) -> DataFrame:
    """k, part and ``list``: the values of each k of ``rows`` (a written table), some LIST to a list; written."""
    parts = written(rows.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("parts")), "list-sizes")
    some = rows.join(maybe_broadcast(parts, 60), "k").groupBy("k", F.pmod(F.xxhash64(value), "parts").alias("part"))
    # structs, as a null id is an id, too, but no list collects it
    return written(some.agg(F.transform(F.collect_list(F.struct(F.col(value).alias("x"))), lambda s: s["x"]).alias("list")), "lists")


def told_users(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """user_id, group_id and keyword: each row of :func:`surge_words`, once, with each of ``wanted`` of its keyword."""
    words = written(words.distinct(), "surge-words")
    # a keyword's rows are its groups times its users: parts of the groups meet all its users, each in a task of its own
    parts = words.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / KEYWORD_PART).alias("parts"))
    parts = maybe_broadcast(written(parts, "surge-parts"), 60)
    some = words.join(parts, "k").select("k", "group_id", F.pmod(F.xxhash64("group_id"), "parts").alias("part"))
    copies = wanted.join(parts, "k").select("k", "user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt(copies, "k", "part").join(dealt(some, "k", "part"), ["k", "part"]).select("user_id", "group_id", F.col("k").alias("keyword"))


def surge_alerts(groups: DataFrame, subs: DataFrame) -> DataFrame:
    """user, group and keyword where a group's keyword is one that the user subscribed surges of, without case."""
    wanted = surge_users(subs)
    return told_users(surge_words(groups, wanted), wanted)


def daily_digest(sns: DataFrame, subs: DataFrame, users: DataFrame, as_of, posts: int = 500, per_keyword: int = 10, limit_bytes: int = FEW_WORDS) -> DataFrame:
    """user, keyword, rank and title: of the ``posts`` best posts of a day, the questions that contain a keyword of a user
    with daily and e-mail alerts on, up to ``per_keyword`` each."""
    best = sns.filter(F.col("snapshot_at") >= ago(as_of, 86400)).orderBy(F.desc("score"), "id").limit(posts)
    asked = best.filter(is_question(F.col("keyword"))).select("id", F.col("keyword").alias("title"), "score")
    words = subs.filter("alert_daily").select(F.lower("keyword").alias("k")).distinct()
    hits = containing(asked.withColumn("_title", F.lower("title")), "_title", words, limit_bytes).drop("_title")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= per_keyword)
    who = subs.filter("alert_daily").select("user_id", F.lower("keyword").alias("k")).distinct().join(users.filter("email_enabled").select("user_id"), "user_id")
    return who.join(hits, "k").select("user_id", F.col("k").alias("keyword"), "rank", "id", "title")


def debounce_alerts(alerts: DataFrame, minutes: int = 10) -> DataFrame:
    """``alerts`` with ``notify``: no alert of the service in the ``minutes`` before."""
    before = F.lag("ts").over(Window.partitionBy("service").orderBy("ts", "event_id"))
    return alerts.withColumn("notify", before.isNull() | (F.col("ts").cast("double") - before.cast("double") >= minutes * 60))


def daily_usage(events: DataFrame, limits: DataFrame) -> DataFrame:
    """user, endpoint, day, calls and whether they reach the limit of the user's plan. ``events``: user_id, endpoint, ts;
    ``limits``: user_id, daily_limit (null: none)."""
    n = events.groupBy("user_id", "endpoint", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    return n.join(limits, "user_id", "left").withColumn("over", F.coalesce(F.col("calls") >= F.col("daily_limit"), F.lit(False)))


def archive_split(audit: DataFrame, as_of, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Rows to move to the archive (older than ``days``) and rows that remain."""
    old = F.coalesce(F.col("created_at") < ago(as_of, days * 86400), F.lit(False))
    return audit.filter(old), audit.filter(~old)


def expire_plans(subs: DataFrame, users: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Subscriptions with the overdue active ones expired; users without an active one left downgraded to free, if one
    of theirs expired now."""
    late = (F.col("status") == "active") & (F.col("expires_at") < ts(as_of))
    after = subs.withColumn("status", F.when(late, "expired").otherwise(F.col("status")))
    flags = subs.groupBy("user_id").agg(F.max(late.cast("int")).alias("_late"), F.max(((F.col("status") == "active") & ~F.coalesce(late, F.lit(False))).cast("int")).alias("_has"))
    rows = users.join(flags, "user_id", "left")
    down = (F.coalesce("_late", F.lit(0)) == 1) & (F.coalesce("_has", F.lit(0)) == 0)
    return after, rows.withColumn("plan", F.when(down, "free").otherwise(F.col("plan"))).drop("_late", "_has")


def backfill_category(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Articles of the default category with the category of the feed of their source's name."""
    by = feeds.groupBy(F.col("name").alias("source")).agg(F.min("category").alias("_c"))
    plain = F.coalesce("category", F.lit("general")) == "general"
    return articles.join(by, "source", "left").withColumn("category", F.when(plain, F.coalesce("_c", F.lit("general"))).otherwise(F.col("category"))).drop("_c")
