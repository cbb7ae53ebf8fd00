"""Scores of articles and groups: freshness, composite, momentum, growth, early trend, boosts, ranking features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.clusters import group_titles
from tidewatch.operators.keywords import group_keywords
from tidewatch.operators.series import detect_burst, hourly_series
from tidewatch.params import Weights
from tidewatch.sources.tables import ago, ts

#: Decay per minute by category, factor by article count, reliability by kind of source.
DECAY = {"breaking": 0.10, "politics": 0.04, "it": 0.02}
FEW = {1: 0.3, 2: 0.5, 3: 0.7, 4: 0.85}
RELIABILITY = {"major_news": 15.0, "news": 10.0, "community": 5.0, "sns": 3.0, "blog": 2.0}


def round_up_tie(x: Column, n: int) -> Column:
    return F.round(x + 1e-9, n)


def seconds_before(as_of, t: Column) -> Column:
    return ts(as_of).cast("double") - t.cast("double")


def freshness(published: Column, category: Column, as_of) -> Column:
    rate = F.lit(0.05)
    for name, value in DECAY.items():
        rate = F.when(category == name, value).otherwise(rate)
    return 100 * F.exp(-rate * F.greatest(F.lit(0.0), seconds_before(as_of, published) / 60))


def _log_share(x: Column, full: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log2(x + 1) / F.log2(F.lit(full + 1))))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def trend_score(rows: DataFrame, as_of, w: Weights | None = None) -> DataFrame:
    """``rows`` with ``freshness``, ``score`` (0 to 100) and ``raw_total``. Needs published_at, category, source_type,
    article_count, source_count, social_signal, keyword_importance, burst_score, velocity."""
    w, c = w or Weights(), F.col
    fresh = freshness(c("published_at"), c("category"), as_of)
    points = (F.least(fresh, F.lit(100.0)) / 100 * w.freshness + _log_share(c("source_count"), 5) * w.source_diversity + _log_share(c("article_count"), 10) * w.article_count + _log_share(c("social_signal"), 50) * w.social
              + _unit(c("keyword_importance")) * w.keyword + _unit(c("burst_score")) * w.burst + _unit(c("velocity")) * w.velocity)
    few = F.lit(1.0)
    for n, factor in FEW.items():
        few = F.when(c("article_count") == n, factor).otherwise(few)
    kind = F.lit(1.0)
    for name, value in RELIABILITY.items():
        kind = F.when(c("source_type") == name, value).otherwise(kind)
    bonus = F.when(c("article_count") <= 1, 0.0).otherwise(F.least(F.lit(20.0), 5 * F.log2(c("article_count"))))
    raw = fresh + kind + bonus + F.greatest(F.lit(0.0), c("social_signal")) + F.greatest(F.lit(0.0), c("keyword_importance"))
    return rows.withColumns({"freshness": fresh, "score": round_up_tie(round_up_tie(points, 2) * few, 2), "raw_total": raw})


def within(as_of, t: str, seconds: int) -> Column:
    return F.count(F.when(seconds_before(as_of, F.col(t)) < seconds, 1))


def _velocity(h: Column, d: Column) -> Column:
    return F.least(F.lit(1.0), h / F.greatest(d / 24, F.lit(0.1)) / 5)


def momentum(articles: DataFrame, as_of, key: str = "group_id") -> DataFrame:
    """key and velocity: articles of the last hour over the day's hourly mean (0.1 at least), over 5, at most 1. Future
    articles count."""
    n = articles.filter(F.col(key).isNotNull()).groupBy(key).agg(within(as_of, "publish_time", 3600).alias("h"), within(as_of, "publish_time", 86400).alias("d"))
    return n.select(key, _velocity(F.col("h"), F.col("d")).alias("velocity"))


def momentum_15m(c15: Column, c1h: Column, c24: Column, divisor: float = 5.0) -> Column:
    return F.least(F.lit(1.0), (2.0 * c15 + (c1h - c15)) / F.greatest(c24 / 24, F.lit(0.1)) / max(divisor, 0.1))


def growth_windows(articles: DataFrame, as_of, key: str = "group_id", hours: int = 12) -> DataFrame:
    """key and the articles of the newest three windows; future articles are left out."""
    age = F.floor(seconds_before(as_of, F.col("publish_time")) / (hours * 3600))
    counts = [F.count(F.when(age == i, 1)).alias(f"w{i}") for i in range(3)]
    return articles.filter(F.col(key).isNotNull()).groupBy(key).agg(*counts)


def growth_type(recent: Column, mid: Column, old: Column) -> Column:
    """spike, growth or unknown from three windows; a null ``old`` means there are two only, a null ``mid`` one."""
    spike = (mid <= 2) & (recent >= 3 * F.greatest(mid, F.lit(1)))
    grows = F.when(old.isNull(), recent >= mid * 1.5).otherwise((recent >= mid * 1.2) & (mid >= old * 1.1))
    return F.when(mid.isNull(), "unknown").when(spike, "spike").when(grows, "growth").otherwise("unknown")


def _early(n: Column, sources: Column, newest: Column, velocity: Column, as_of) -> Column:
    hours = F.least(F.lit(48.0), F.greatest(F.lit(0.0), seconds_before(as_of, newest) / 3600))
    score = round_up_tie(0.4 * velocity + 0.3 * sources / n + 0.3 * (1 - F.coalesce(hours, F.lit(48.0)) / 48), 4)
    return F.when(sources < 2, 0.0).when(n < 3, F.least(score, F.lit(0.3))).otherwise(score)


def group_figures(articles: DataFrame, as_of, hours: int = 12, first: tuple[str, ...] = (), key: str = "group_id") -> DataFrame:
    """All that one row per group counts: ``n`` articles, ``sources`` that are named, ``newest``, velocity, the three growth
    windows w0 to w2, early_trend_score and, if ``first`` names columns, those of the first article by them as ``f``.

    Counts of a group and source come first, so distinct sources are a count of rows and a group of many articles reaches
    the second shuffle as one row for each of its sources."""
    age = F.floor(seconds_before(as_of, F.col("publish_time")) / (hours * 3600))
    parts = [F.count(F.lit(1)).alias("n"), F.max("publish_time").alias("newest"), within(as_of, "publish_time", 3600).alias("h"), within(as_of, "publish_time", 86400).alias("d"), *[F.count(F.when(age == i, 1)).alias(f"w{i}") for i in range(3)]]
    each = articles.filter(F.col(key).isNotNull()).groupBy(key, F.col("source").alias("_source")).agg(*parts, *([F.min(F.struct(*first)).alias("f")] if first else []))
    sums = [F.sum(c).alias(c) for c in ("n", "h", "d", "w0", "w1", "w2")]
    rows = each.groupBy(key).agg(*sums, F.count(F.when(F.col("_source") != "", 1)).alias("sources"), F.max("newest").alias("newest"), *([F.min("f").alias("f")] if first else []))
    rows = rows.withColumn("velocity", _velocity(F.col("h"), F.col("d")))
    return rows.withColumn("early_trend_score", _early(F.col("n"), F.col("sources"), F.col("newest"), F.col("velocity"), as_of)).drop("h", "d")


def early_score(articles: DataFrame, as_of, key: str = "group_id") -> DataFrame:
    """key and early score: .4 velocity + .3 source diversity + .3 recency over 48 h; 0 for one source, .3 at most for
    fewer than three articles."""
    return group_figures(articles, as_of, key=key).select(key, "early_trend_score")


def source_multiplier(n: Column) -> Column:
    return F.when(n >= 5, 1.5).when(n == 4, 1.3).when(n == 3, 1.2).when(n == 2, 1.1).otherwise(1.0)


def external_boost(groups: DataFrame, sns: DataFrame, as_of, platforms: tuple[str, ...] = ("google_trends", "naver")) -> DataFrame:
    """group and boost 1.0, 1.1 or 1.3 for none, one or two of the known platforms with a keyword of the group in its
    locale within a day. Posts are reduced to distinct keys before the join, so a hot keyword is a few rows."""
    posts = sns.filter(F.col("platform").isin(*platforms) & (F.col("snapshot_at") >= ago(as_of, 86400))).select("platform", "locale", F.lower("keyword").alias("k")).distinct()
    words = groups.select("id", "locale", F.explode("keywords").alias("k")).withColumn("k", F.lower("k")).distinct()
    n = words.join(posts, ["k", "locale"]).groupBy("id").agg(F.countDistinct("platform").alias("platforms"))
    n = groups.select("id").join(n, "id", "left").withColumn("platforms", F.coalesce("platforms", F.lit(0)))
    return n.select("id", "platforms", F.when(F.col("platforms") >= 2, 1.3).when(F.col("platforms") == 1, 1.1).otherwise(1.0).alias("boost"))


def refresh_early(groups: DataFrame, articles: DataFrame, sns: DataFrame, as_of, weights: tuple[float, float, float, float] = (0.3, 0.3, 0.2, 0.2)) -> DataFrame:
    """group and its new early score, for groups of the last 48 h that have articles."""
    wb, wv, wd, wr = weights
    active = groups.filter(F.col("created_at") > ago(as_of, 48 * 3600)).select("id", "burst_score", "keywords", "locale")
    n = articles.filter("group_id is not null").groupBy(F.col("group_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.max("publish_time").alias("newest"),
        within(as_of, "publish_time", 900).alias("c15"), within(as_of, "publish_time", 3600).alias("c1h"), within(as_of, "publish_time", 86400).alias("c24"))
    rows = active.join(n, "id").join(external_boost(active, sns, as_of), "id")
    recency = F.greatest(F.lit(0.0), 1 - F.coalesce(seconds_before(as_of, F.col("newest")) / 3600, F.lit(48.0)) / 48)
    total = wb * F.least(F.lit(1.0), F.coalesce("burst_score", F.lit(0.0))) + wv * momentum_15m(F.col("c15"), F.col("c1h"), F.col("c24")) + wd * F.col("sources") / F.col("n") + wr * recency
    score = round_up_tie(_unit(total), 4)
    score = F.when(F.col("sources") < 2, 0.0).when(F.col("n") < 3, F.least(score, F.lit(0.3))).otherwise(score)
    return rows.select("id", round_up_tie(F.least(F.lit(1.0), score * F.col("boost")), 4).alias("early_trend_score"))


def score_groups(assigned: DataFrame, sns: DataFrame, as_of, w: Weights | None = None) -> DataFrame:
    """One row per group of ``assigned`` (articles with group_id, keywords, keyword_importance): counts, burst, velocity,
    growth, multipliers, score, early score, title and keywords. The first article by time, then id, stands for it."""
    rows = assigned.filter("group_id is not null")
    base = group_figures(rows, as_of, first=("publish_time", "article_id", "category", "source", "locale", "keyword_importance"))
    base = base.select("group_id", "f", F.col("n").alias("article_count"), F.greatest(F.lit(1), F.col("sources")).alias("source_count"), "velocity", growth_type(F.col("w0"), F.col("w1"), F.col("w2")).alias("growth_type"), "early_trend_score")
    burst = detect_burst(hourly_series(rows, "group_id", "publish_time"), 5).select(F.col("key").alias("group_id"), "burst_score", F.col("level").alias("burst_level"))
    words = group_keywords(rows)
    listed = words.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda e: e["keyword"]).alias("keywords"))
    out = base.join(burst, "group_id", "left").join(group_titles(rows, words), "group_id").join(listed, "group_id", "left")
    out = out.withColumns({"published_at": F.col("f.publish_time"), "category": F.col("f.category"), "locale": F.col("f.locale"), "source_type": F.col("f.source"), "keyword_importance": F.coalesce("f.keyword_importance", F.lit(0.0)),
                           "social_signal": F.lit(0.0), "burst_score": F.coalesce("burst_score", F.lit(0.0)), "burst_level": F.coalesce("burst_level", F.lit("end")), "keywords": F.coalesce("keywords", F.array().cast("array<string>"))})
    out = trend_score(out, as_of, w).drop("f")
    boost = external_boost(out.select(F.col("group_id").alias("id"), "locale", "keywords"), sns, as_of).select(F.col("id").alias("group_id"), F.col("boost").alias("external_boost"))
    out = out.join(boost, "group_id").withColumn("multiplier", source_multiplier(F.col("source_count")))
    return out.withColumn("score", round_up_tie(F.least(F.lit(100.0), F.col("score") * F.col("multiplier") * F.col("external_boost")), 2))


def trend_status(score: Column, previous: Column, direction: Column) -> Column:
    up, down = F.coalesce(direction.isin("up", "rising"), F.lit(False)), F.coalesce(direction.isin("down", "declining"), F.lit(False))
    change = F.when(previous > 0, (score - previous) / previous).otherwise(0.0)
    return (F.when((change > 0.5) | ((score > 80) & up), "exploding").when((change > 0.1) | up, "rising").when((change > -0.1) & (score > 60) & (down | (change < 0)), "peaked")
            .when((change < -0.1) | down, "declining").otherwise("stable"))


def burst_candidates(groups: DataFrame, jobs: DataFrame, seasonal: DataFrame, as_of, threshold: float = 0.75, cooldown_hours: int = 2, top: int = 3, words: int = 3) -> DataFrame:
    """The ``top`` groups of the last 48 h from ``threshold`` without a running or successful job in the cooldown, with up
    to ``words`` usable keywords and whether one of them is seasonal (``seasonal``: keyword, seasonal)."""
    recent = jobs.filter(F.col("status").isin("running", "success") & (F.col("triggered_at") > ago(as_of, cooldown_hours * 3600))).select(F.col("group_id").alias("id")).distinct()
    rows = groups.filter((F.col("early_trend_score") >= threshold) & (F.col("created_at") > ago(as_of, 48 * 3600))).join(recent, "id", "left_anti")
    best = rows.orderBy(F.desc("early_trend_score"), "id").limit(top).select("id", "locale", "early_trend_score", F.filter(F.slice("keywords", 1, words), lambda k: (F.length(k) >= 2) & ~k.rlike("^[0-9]+$")).alias("keywords")).filter("size(keywords) > 0")
    flag = best.select("id", F.explode("keywords").alias("keyword")).join(seasonal.filter("seasonal").select("keyword"), "keyword").select("id").distinct().withColumn("is_seasonal", F.lit(True))
    return best.join(flag, "id", "left").withColumn("is_seasonal", F.coalesce("is_seasonal", F.lit(False)))


def rescale_scores(groups: DataFrame) -> DataFrame:
    """Scores scaled so that the largest is 100, if it is above."""
    top = groups.agg(F.max("score").alias("_top"))
    scaled = F.when(F.col("_top") > 100, round_up_tie(F.col("score") / F.col("_top") * 100, 2)).otherwise(F.col("score"))
    return groups.crossJoin(F.broadcast(top)).withColumn("score", scaled).drop("_top")  # one row


def correct_scores(groups: DataFrame, articles: DataFrame) -> DataFrame:
    """Groups with lower scores for two to four articles, and early score 0 where all articles have one source."""
    n = articles.filter("group_id is not null").groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("source").alias("_s"))
    factor = F.when(F.col("_n") == 2, 0.5).when(F.col("_n") == 3, 0.7).when(F.col("_n") == 4, 0.85).otherwise(1.0)
    rows = groups.join(n, "id", "left")
    return rows.withColumns({"score": round_up_tie(F.col("score") * factor, 2), "early_trend_score": F.when(F.col("_s") <= 1, 0.0).otherwise(F.col("early_trend_score"))}).drop("_n", "_s")


RANKING = ("freshness_exp", "hour_of_day", "age_bucket", "source_reliability", "diversity_bonus", "group_count", "social_signal", "ctr", "dwell_time", "body_length", "has_summary", "keyword_importance", "category_weight", "source_affinity", "cf_score", "fatigue_penalty", "diversity_bonus_mmr")


def ranking_features(rows: DataFrame, as_of) -> DataFrame:
    """``rows`` with the 17 ranking features as doubles; absent inputs take their defaults."""
    have = set(rows.columns)
    opt = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in have else F.lit(d)
    minutes = F.greatest(F.lit(0.0), seconds_before(as_of, F.col("published_at")) / 60)
    kind = F.lit(1.0)
    for name, value in RELIABILITY.items():
        kind = F.when(F.col("source_type") == name, value).otherwise(kind) if "source_type" in have else kind
    diverse = F.when(F.size("sources") > 0, F.size(F.array_distinct("sources")) / F.size("sources")).otherwise(0.0) if "sources" in have else F.lit(0.0)
    values = {
        "freshness_exp": freshness(F.col("published_at"), F.col("category"), as_of), "hour_of_day": F.hour("published_at"), "age_bucket": F.when(minutes < 60, 0).when(minutes < 360, 1).when(minutes < 1440, 2).when(minutes < 10080, 3).otherwise(4),
        "source_reliability": kind, "diversity_bonus": diverse, "group_count": opt("article_count", 1.0), "social_signal": F.greatest(F.lit(0.0), opt("social_signal")), "ctr": opt("ctr"), "dwell_time": opt("dwell_ms") / 1000,
        "body_length": F.least(opt("body_length"), F.lit(50000.0)), "has_summary": opt("has_summary"), "keyword_importance": F.greatest(F.lit(0.0), opt("keyword_importance")), "category_weight": opt("category_weight", 1.0),
        "source_affinity": opt("source_affinity"), "cf_score": opt("cf_score"), "fatigue_penalty": opt("fatigue_penalty"), "diversity_bonus_mmr": opt("diversity_bonus_mmr"),
    }
    return rows.withColumns({k: v.cast("double") for k, v in values.items()})


def ranking_training_set(actions: DataFrame, groups: DataFrame, as_of, days: int = 30, min_impressions: int = 5) -> DataFrame:
    """item, clicks, impressions, mean dwell and relevance 2 ctr + .5 min(dwell / 30 s, 1), for items of known groups."""
    rows = actions.filter((F.col("item_type") == "trend") & (F.col("created_at") > ago(as_of, days * 86400)))
    n = rows.groupBy(F.col("item_id").alias("id")).agg(F.count(F.when(F.col("action") == "click", 1)).alias("clicks"), F.count(F.when(F.col("action").isin("click", "page_view"), 1)).alias("impressions"), F.coalesce(F.avg(F.when(F.col("dwell_ms") > 0, F.col("dwell_ms"))), F.lit(0.0)).alias("avg_dwell"))
    out = n.filter(F.col("impressions") >= min_impressions).join(groups.select("id", "category", F.col("score").alias("current_score")), "id")
    return out.withColumn("relevance", 2 * F.col("clicks") / F.greatest("impressions", F.lit(1)) + 0.5 * F.least(F.col("avg_dwell") / 30000, F.lit(1.0)))
