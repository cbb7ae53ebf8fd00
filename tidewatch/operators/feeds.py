"""Feeds, timelines, search and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import FEW_WORDS, containing
from tidewatch.operators.scoring import round_up_tie, seconds_before
from tidewatch.runtime import maybe_broadcast, written
from tidewatch.sources.search_index import look_up
from tidewatch.sources.tables import ago, ts

#: Bucket and range in minutes.
PRESETS = {"15m": (15, 360), "30m": (30, 720), "1h": (60, 1440), "6h": (360, 10080), "24h": (1440, 43200), "7d": (10080, 129600)}
SORTS = ("score", "burst_score", "article_count", "created_at")


def article_counts(articles: DataFrame, as_of) -> DataFrame:
    """group, its articles, and those of the last three hours and the three before: one pass for every feed."""
    age = seconds_before(as_of, F.col("publish_time"))
    return articles.filter("group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("article_count"), F.count(F.when(age <= 10800, 1)).alias("recent"), F.count(F.when((age > 10800) & (age <= 21600), 1)).alias("previous"))


def direction_of(recent: Column, previous: Column) -> Column:
    return F.when((recent > previous) & (recent >= 2), "rising").when((recent < previous) & (previous >= 2), "declining").otherwise("steady")


def direction(articles: DataFrame, as_of) -> DataFrame:
    return article_counts(articles, as_of).select("group_id", "recent", "previous", direction_of(F.col("recent"), F.col("previous")).alias("direction"))


def _counted(groups: DataFrame, articles: DataFrame, as_of) -> DataFrame:
    n = article_counts(articles, as_of).withColumnRenamed("group_id", "id")
    return groups.join(n, "id").filter("article_count >= 2 and not is_hidden").withColumn("direction", direction_of(F.col("recent"), F.col("previous"))).drop("recent", "previous")


def trend_feed(groups: DataFrame, articles: DataFrame, as_of, categories: list[str] | None = None, locale: str | None = None, since_hours: int | None = None, sort: str = "score", limit: int | None = 20) -> DataFrame:
    """Visible groups from score 5 with two articles or more, ordered by ``sort`` (ties: id)."""
    if sort not in SORTS:
        raise ValueError(f"sort is one of {SORTS}")
    rows = groups.filter("score >= 5.0")
    if categories:
        rows = rows.filter(F.col("category").isin(*categories))
    if locale:
        rows = rows.filter(F.col("locale") == locale)
    if since_hours:
        rows = rows.filter(F.col("created_at") > ago(as_of, since_hours * 3600))
    rows = _counted(rows, articles, as_of).orderBy(F.desc(sort), "id")
    return rows.limit(limit) if limit else rows


def keyset_page(rows: DataFrame, after: tuple[float, str] | None, n: int) -> DataFrame:
    """The ``n`` rows behind ``after`` = (score, id) in the order score down, id up."""
    if after:
        score, id_ = after
        rows = rows.filter((F.col("score") < score) | ((F.col("score") == score) & (F.col("id") > id_)))
    return rows.orderBy(F.desc("score"), "id").limit(n)


def early_feed(groups: DataFrame, articles: DataFrame, as_of, floor: float = 0.4, limit: int = 20) -> DataFrame:
    return _counted(groups.filter(F.col("early_trend_score") > floor), articles, as_of).orderBy(F.desc("early_trend_score"), "id").limit(limit)


def related_trends(groups: DataFrame, articles: DataFrame, as_of, n: int = 10) -> DataFrame:
    """For every group the ``n`` best visible others of its category. Only the best n + 1 of a category are joined, so
    a category with most groups makes n + 1 rows a group, not all pairs."""
    w = Window.partitionBy("category").orderBy(F.desc("score"), "id")
    best = _counted(groups, articles, as_of).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n + 1).select("category", F.col("id").alias("related_id"), F.col("score").alias("related_score"), "place")
    rows = groups.select("id", "category").join(best, "category").filter("id <> related_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("place"))).filter(F.col("rank") <= n)
    return rows.select("id", "related_id", "related_score", "rank")


def trend_detail(groups: DataFrame, articles: DataFrame, ids: DataFrame, n: int = 50, snippet: int = 200) -> DataFrame:
    """Groups of ``ids`` (id) with their ``n`` newest articles, one row each."""
    rows = articles.join(ids.select(F.col("id").alias("group_id")).distinct(), "group_id", "left_semi")
    w = Window.partitionBy("group_id").orderBy(F.desc("publish_time"), "article_id")
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.join(groups.select(F.col("id").alias("group_id"), F.col("title").alias("group_title"), "score"), "group_id").select("group_id", "group_title", "score", "rank", "article_id", "title", F.substring("body", 1, snippet).alias("snippet"))


def timeline(articles: DataFrame, ids: DataFrame, preset: str, as_of) -> DataFrame:
    """id, bucket number and start, articles and distinct sources, zero-filled, from as_of - range to as_of inclusive."""
    width, span = PRESETS[preset]
    buckets = span // width + 1
    keys = ids.select(F.col("id").alias("group_id")).distinct()
    offset = span * 60 - seconds_before(as_of, F.col("publish_time"))
    rows = articles.join(keys, "group_id", "left_semi").withColumn("bucket", F.floor(offset / (width * 60)).cast("int")).filter(F.col("bucket").between(0, buckets - 1))
    n = rows.groupBy("group_id", "bucket").agg(F.count(F.lit(1)).alias("article_count"), F.countDistinct("source").alias("source_count"))
    spine = keys.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    out = spine.join(n, ["group_id", "bucket"], "left")
    start = ago(as_of, span * 60) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("bucket") * width * 60)
    return out.select("group_id", "bucket", start.alias("bucket_start"), F.coalesce("article_count", F.lit(0)).alias("article_count"), F.coalesce("source_count", F.lit(0)).alias("source_count"))


def compare(articles: DataFrame, groups: DataFrame, ids: list[str], preset: str, as_of) -> DataFrame:
    """Timelines of two to five groups side by side, with their titles."""
    if not 2 <= len(set(ids)) <= 5:
        raise ValueError("compare two to five groups")
    some = groups.filter(F.col("id").isin(*ids))
    return timeline(articles, some.select("id"), preset, as_of).join(some.select(F.col("id").alias("group_id"), "title"), "group_id")


def news_feed(articles: DataFrame, groups: DataFrame, as_of, category: str | None = None, locale: str | None = None, source: str | None = None, since_hours: int | None = None, limit: int | None = 20) -> DataFrame:
    """The newest article per group (articles without one stand alone), with the group's size, newest first."""
    rows = articles.join(groups.select(F.col("id").alias("group_id"), "summary", F.col("category").alias("group_category")), "group_id", "left")
    for col, value in (("group_category", category), ("locale", locale), ("source", source)):
        rows = rows.filter(F.col(col) == value) if value else rows
    if since_hours:
        rows = rows.filter(F.col("publish_time") > ago(as_of, since_hours * 3600))
    grouped, alone = rows.filter("group_id is not null"), rows.filter("group_id is null")
    w = Window.partitionBy("group_id").orderBy(F.desc("publish_time"), "article_id")
    first = grouped.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    size = articles.filter("group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("article_count"))
    out = first.join(size, "group_id").unionByName(alone.withColumn("article_count", F.lit(1).cast("long")))
    out = out.select("article_id", "title", "url", "source", "publish_time", "summary", "article_count").orderBy(F.desc("publish_time"), "article_id")
    return out.limit(limit) if limit else out


def _containing(rows: DataFrame, text: str, queries: DataFrame, limit_bytes: int = FEW_WORDS) -> DataFrame:
    """Rows with the query_id of every query (query_id, keywords) one of whose keywords their text contains, without case."""
    words = queries.select("query_id", F.explode("keywords").alias("k")).select("query_id", F.lower("k").alias("k")).distinct()
    return containing(rows.withColumn("_text", F.lower(text)), "_text", words, limit_bytes).drop("k", "_text").distinct()


def search_articles(articles: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    hits = _containing(articles.select("article_id", "title", "publish_time"), "title", queries)
    w = Window.partitionBy("query_id").orderBy(F.desc("publish_time"), "article_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query_id", "rank", "article_id", "title")


def search_index(spark: SparkSession, folder: str, queries: DataFrame, n: int = 10, batches: list[str] | None = None) -> DataFrame:
    """:func:`search_articles` over the index under ``folder``, whose texts are lower-cased titles beside title and
    publish_time; ``id`` is the article's."""
    words = queries.select("query_id", F.explode("keywords").alias("k")).select("query_id", F.lower("k").alias("k")).distinct()
    hits = look_up(spark, folder, words, batches).select("query_id", F.col("id").alias("article_id"), "title", "publish_time").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("publish_time"), "article_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query_id", "rank", "article_id", "title")


def search_trends(sns: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    hits = _containing(sns.select("id", "platform", "keyword", "score"), "keyword", queries)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query_id", "rank", "id", "platform", "keyword", "score")


def dashboard(groups: DataFrame, articles: DataFrame, as_of) -> DataFrame:
    """Figures of the last day in long form (kind, name, value): totals, trends by category, articles by source and the
    category with most trends. Categories and totals are grouping sets of one pass over each table; without rows the
    totals are 0."""
    one = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    good = F.col("score") >= 5.0
    recent = groups.filter(F.col("created_at") > ago(as_of, 86400)).select("category", "score", "early_trend_score")
    sets = recent.groupingSets([["category"], []], "category").agg(F.grouping_id().alias("all"), F.count(F.when(good, 1)).alias("n"), F.avg(F.when(good, F.col("score"))).alias("mean"), F.count(F.when(F.col("early_trend_score") > 0.3, 1)).alias("early"))
    sets = sets.filter("all = 1 or n > 0").withColumn("r", F.row_number().over(Window.partitionBy("all").orderBy(F.desc("n"), "category")))  # a row for each category
    total = F.array(one("total", F.lit("total_trends"), F.col("n")), one("total", F.lit("avg_score"), round_up_tie(F.coalesce("mean", F.lit(0.0)), 1)), one("total", F.lit("early_signal_count"), F.col("early")))
    category = F.array(one("category", F.col("category"), F.col("n")))
    best = F.when(F.col("r") == 1, F.array(one("top_category", F.col("category"), F.col("n")))).otherwise(F.array().cast("array<struct<kind:string,name:string,value:double>>"))
    trends = sets.select(F.inline(F.when(F.col("all") == 1, total).otherwise(F.concat(category, best))))
    news = articles.filter(F.col("publish_time") > ago(as_of, 86400)).groupingSets([["source"], []], "source").agg(F.grouping_id().alias("all"), F.count(F.lit(1)).cast("double").alias("value")).filter("all = 1 or source is not null")
    counts = news.select(F.when(F.col("all") == 1, "total").otherwise("source").alias("kind"), F.when(F.col("all") == 1, "total_news").otherwise(F.col("source")).alias("name"), "value")
    names = F.array(*map(F.lit, ("total_trends", "avg_score", "early_signal_count", "total_news")))
    none = groups.sparkSession.range(1).select(F.lit("total").alias("kind"), F.explode(names).alias("name"), F.lit(0.0).alias("value"))  # grouping sets of no rows are no rows
    return trends.unionByName(counts).unionByName(none).groupBy("kind", "name").agg(F.max("value").alias("value"))


def regional(groups: DataFrame, as_of, locales: int = 20, n: int = 3) -> DataFrame:
    """The ``locales`` with most groups of the last day and their ``n`` best group ids."""
    rows = groups.filter((F.col("created_at") > ago(as_of, 86400)) & F.col("locale").isNotNull())
    top = rows.groupBy("locale").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "locale").limit(locales)
    w = Window.partitionBy("locale").orderBy(F.desc("score"), "id")
    best = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).groupBy("locale").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda e: e["id"]).alias("top_trends"))
    return top.join(best, "locale")


def pipeline_stats(articles: DataFrame, groups: DataFrame, day) -> DataFrame:
    """One row: articles collected since ``day``, clustered, filtered (the rest), groups created."""
    a = articles.filter(F.col("created_at") >= ts(day)).agg(F.count(F.lit(1)).alias("collected"), F.count("group_id").alias("clustered"))
    g = groups.filter(F.col("created_at") >= ts(day)).agg(F.count(F.lit(1)).alias("trends_created"))
    return a.crossJoin(g).withColumn("spam_filtered", F.greatest(F.lit(0), F.col("collected") - F.col("clustered")))  # one row each


def top_trends(groups: DataFrame, articles: DataFrame, n: int = 10) -> DataFrame:
    size = articles.filter("group_id is not null").groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("article_count"))
    best = groups.filter("not is_hidden").orderBy(F.desc("score"), "id").limit(n)
    return best.join(size, "id", "left").select("id", "title", "score", "burst_score", "category", "locale", F.coalesce("article_count", F.lit(0)).alias("article_count"))


def feed_health(attempts: DataFrame, memory: int = 200) -> DataFrame:
    """Per feed, from its attempts in order of time and event: last times, last error, failures at the end, totals and the
    latency smoothed .7 old, .3 new (6 digits).

    Totals and last times are pre-aggregated sums and maxima; only the last ``memory`` attempts of a feed are ranked for
    the latency, as what lies further back weighs less than .7^200."""
    at, ok = F.struct("ts", "event_id"), F.col("success")
    totals = attempts.groupBy("feed_id").agg(
        F.max("ts").alias("last_crawled_at"), F.max(F.when(ok, F.col("ts"))).alias("last_success_at"), F.max(F.when(~ok, F.col("ts"))).alias("last_error_at"), F.max_by("error", F.when(~ok, at)).alias("last_error"),
        F.max(F.when(ok, at)).alias("_ok"), F.count(F.lit(1)).alias("total_crawl_count"), F.count(F.when(~ok, 1)).alias("total_error_count"))
    totals = written(totals, "feed-totals")
    ends = attempts.join(maybe_broadcast(totals.select("feed_id", "_ok"), 64), "feed_id").filter(~ok & (F.col("_ok").isNull() | (at > F.col("_ok"))))
    ends = ends.groupBy("feed_id").agg(F.count(F.lit(1)).alias("_failures"))
    w = Window.partitionBy("feed_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = attempts.select("feed_id", "latency_ms", "ts", "event_id").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= memory)
    # the weight of an attempt k steps from the end is .3 * .7^k, of the oldest .7^k
    sums = last.groupBy("feed_id").agg(F.sum(F.col("latency_ms") * 0.3 * F.pow(F.lit(0.7), F.col("k") - 1)).alias("_sum"), F.max("k").alias("_n"), F.max_by("latency_ms", "k").alias("_old"))
    out = totals.join(ends, "feed_id", "left").join(sums, "feed_id", "left")
    latency = F.col("_sum") + F.when(F.col("_n") == F.col("total_crawl_count"), 0.7 * F.col("_old") * F.pow(F.lit(0.7), F.col("_n") - 1)).otherwise(0.0)
    return out.select("feed_id", "last_crawled_at", "last_success_at", "last_error_at", "last_error", F.coalesce("_failures", F.lit(0)).cast("long").alias("consecutive_failures"), "total_crawl_count", "total_error_count", F.round(latency, 6).alias("avg_latency_ms"))


def health_status(as_of) -> Column:
    stale = F.coalesce(ts(as_of).cast("double") - F.col("last_success_at").cast("double") > 1800, F.lit(False))
    return F.when(F.col("last_crawled_at").isNull(), "unknown").when(F.col("consecutive_failures") >= 5, "error").when((F.col("consecutive_failures") >= 2) | stale, "degraded").otherwise("healthy")


def health_summary(feeds: DataFrame, as_of) -> DataFrame:
    """Per source type the feeds in total and by status. ``feeds``: source_type and the columns of :func:`feed_health`."""
    rows = feeds.withColumn("s", health_status(as_of))
    return rows.groupBy("source_type").agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("s") == s, 1)).alias(s) for s in ("healthy", "degraded", "error", "unknown")])


def filtered_page(rows: DataFrame, equal: dict | None = None, between: dict | None = None, contains: dict | None = None, order: list | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the rows that pass all predicates, each with the total that passes as ``total``."""
    for c, v in (equal or {}).items():
        rows = rows.filter(F.col(c) == v)
    for c, (low, high) in (between or {}).items():
        rows = rows.filter((F.col(c) >= low) & (F.col(c) < high))
    for c, v in (contains or {}).items():
        rows = rows.filter(F.lower(c).contains(v.lower()))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*(order or [rows.columns[0]])).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def account_rollups(users: DataFrame, plans: DataFrame, usage: DataFrame, groups: DataFrame, day) -> DataFrame:
    """Account figures in long form (kind, name, value), by rollups: users, active users and users by plan, active
    subscriptions by plan, users with usage, groups in total and of the day."""
    by = users.rollup("plan").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_active"), 1)).alias("active"), F.grouping("plan").alias("g"))
    u = by.select(F.explode(F.when(F.col("g") == 1, F.array(F.struct(F.lit("users").alias("kind"), F.lit("total").alias("name"), F.col("n").alias("value")), F.struct(F.lit("users").alias("kind"), F.lit("active").alias("name"), F.col("active").alias("value")))).otherwise(F.array(F.struct(F.lit("users_by_plan").alias("kind"), F.col("plan").alias("name"), F.col("n").alias("value"))))).alias("x")).select("x.*")
    s = plans.filter("status = 'active'").groupBy(F.col("plan").alias("name")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("subscriptions_by_plan").alias("kind"), "name", "value")
    a = usage.agg(F.countDistinct("user_id").alias("value")).select(F.lit("usage").alias("kind"), F.lit("users").alias("name"), "value")
    g = groups.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("created_at") >= ts(day), 1)).alias("today"))
    g = g.select(F.explode(F.create_map(F.lit("total"), "total", F.lit("today"), "today")).alias("name", "value")).select(F.lit("groups").alias("kind"), "name", "value")
    return reduce(lambda x, y: x.unionByName(y), [u, s, a, g])
