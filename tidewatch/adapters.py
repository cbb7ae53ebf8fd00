"""Views of the test tables in the shape of articles, groups, posts, actions and the small tables around them.

Each view is one SELECT that Spark and DuckDB both read; what differs between them is filled in by dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.runtime import shipped, small_batches

AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "articles": """SELECT doc_id AS article_id, 'https://' || source || '.example/' || CAST(CASE WHEN doc_id % 37 = 0 AND doc_id >= 20 THEN doc_id - 20 ELSE doc_id END AS VARCHAR(20)) AS url,
        substr(split_part(text, chr(10), 1), 1, 120) AS title, text AS body, source, lang AS locale, @sec(1706486400, (doc_id * 7919) % 172800) AS publish_time,
        @sec(1706486400, (doc_id * 7919) % 172800) AS created_at,
        CASE doc_id % 5 WHEN 0 THEN 'breaking' WHEN 1 THEN 'politics' WHEN 2 THEN 'it' WHEN 3 THEN 'tech' ELSE 'general' END AS category,
        CASE WHEN doc_id % 40 < 20 THEN 'g' || CAST(CAST(floor(doc_id / 40) AS BIGINT) * 4 AS VARCHAR(20))
             WHEN doc_id % 40 < 30 THEN 'g' || CAST(CAST(floor(doc_id / 40) AS BIGINT) * 4 + 1 AS VARCHAR(20))
             WHEN doc_id % 40 < 33 THEN 'g' || CAST(CAST(floor(doc_id / 40) AS BIGINT) * 4 + 2 AS VARCHAR(20))
             WHEN doc_id % 40 < 34 THEN 'g' || CAST(CAST(floor(doc_id / 40) AS BIGINT) * 4 + 3 AS VARCHAR(20)) END AS group_id
        FROM documents""",
    "groups": """SELECT 'g' || CAST(n AS VARCHAR(20)) AS id, CASE n % 5 WHEN 0 THEN 'breaking' WHEN 1 THEN 'politics' WHEN 2 THEN 'it' WHEN 3 THEN 'tech' ELSE 'general' END AS category,
        CASE n % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS locale, 'Group ' || CAST(n AS VARCHAR(20)) AS title, 'Summary ' || CAST(n AS VARCHAR(20)) AS summary,
        CAST((n * 37) % 1000 AS DOUBLE) / 10 AS score, CAST((n * 53) % 101 AS DOUBLE) / 100 AS early_trend_score,
        @list('k' || CAST(n % 7 AS VARCHAR(20)), 'k' || CAST((n * 3) % 13 AS VARCHAR(20)), 'topic' || CAST(n % 29 AS VARCHAR(20)), CAST(n % 10 AS VARCHAR(20))) AS keywords,
        @sec(1706659200, 0 - (n * 4999) % 345600) AS created_at, @sec(1706659200, 0 - (n * 4999) % 345600) AS updated_at,
        CASE n % 3 WHEN 0 THEN 'spike' WHEN 1 THEN 'growth' ELSE 'unknown' END AS growth_type, CAST((n * 29) % 100 AS DOUBLE) / 100 AS burst_score, n % 17 = 0 AS is_hidden
        FROM (SELECT DISTINCT CAST(floor(doc_id / 40) AS BIGINT) * 4 + CASE WHEN doc_id % 40 < 20 THEN 0 WHEN doc_id % 40 < 30 THEN 1 WHEN doc_id % 40 < 33 THEN 2 ELSE 3 END AS n FROM documents WHERE doc_id % 40 < 34) x""",
    "sns": """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'youtube' WHEN 2 THEN 'google_trends' ELSE 'naver' END AS platform,
        'k' || CAST(event_id % 13 AS VARCHAR(20)) AS keyword, CASE CAST(floor(event_id / 4) AS BIGINT) % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS locale, 'general' AS category,
        round(value, 4) AS score, CAST(CASE WHEN event_id % 13 < 4 THEN 4 + event_id % 3 ELSE event_id % 7 END AS DOUBLE) AS burst_z, CASE WHEN event_id % 13 < 4 THEN 'negative' WHEN event_id % 3 = 0 THEN 'positive' WHEN event_id % 3 = 1 THEN 'negative' ELSE 'neutral' END AS sentiment_badge,
        @sec(1706659200, 0 - (event_id * 61) % 172800) AS snapshot_at FROM events""",
    "posts": """SELECT conv_id * 100 + turn AS id, 'reddit' AS platform, substr(CASE WHEN conv_id % 3 = 0 THEN 'How ' || text WHEN conv_id % 3 = 1 THEN text || '?' ELSE text END, 1, 500) AS keyword,
        'en' AS locale, CAST(conv_id % 50 AS DOUBLE) AS score, @sec(1706659200, 0 - (conv_id * 977 + turn) % 172800) AS snapshot_at FROM conversations""",
    "actions": """SELECT event_id AS id, user_id, CASE event_type WHEN 'view' THEN 'page_view' ELSE event_type END AS action, 'trend' AS item_type, 'g' || CAST(event_id % 41 AS VARCHAR(20)) AS item_id,
        CAST(round(value * 100) AS BIGINT) AS dwell_ms, '{"category": "c' || CAST(event_id % 5 AS VARCHAR(20)) || '"}' AS meta, CAST(ts AS TIMESTAMP) AS created_at FROM events""",
    "series": """SELECT event_type AS key, CAST(ts AS TIMESTAMP) AS ts FROM events""",
    "feeds": """SELECT 'f' || source AS id, CASE WHEN length(source) % 2 = 0 THEN 'rss' ELSE 'community' END AS source_type, source AS name, 'cat_' || source AS category, 'en' AS locale FROM (SELECT DISTINCT source FROM documents) x""",
    "entries": """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL ELSE '  ' || url END AS link, CASE WHEN page_id % 13 = 0 THEN '   ' ELSE ' Title ' || CAST(page_id AS VARCHAR(20)) || ' ' END AS title,
        'Body ' || CAST(page_id AS VARCHAR(20)) AS summary, CASE WHEN page_id % 3 = 0 THEN NULL ELSE @sec(1706572800, page_id) END AS published,
        CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN @sec(1706572800, page_id * 2) END AS updated, 'fsrc' || CAST(page_id % 20 AS VARCHAR(20)) AS feed_id FROM pages""",
    "attempts": """SELECT 'f' || CAST(user_id % 40 AS VARCHAR(20)) AS feed_id, event_id, CAST(ts AS TIMESTAMP) AS ts, event_type <> 'error' AS success, round(value, 3) AS latency_ms,
        CASE WHEN event_type = 'error' THEN 'e' || CAST(event_id % 5 AS VARCHAR(20)) END AS error FROM events""",
    "subs": """SELECT c_custkey AS user_id, 'K' || CAST(c_custkey % 13 AS VARCHAR(20)) AS keyword, c_custkey % 2 = 0 AS alert_surge, c_custkey % 3 = 0 AS alert_daily FROM customer""",
    "daily_subs": """SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'the' WHEN 1 THEN 'tion' WHEN 2 THEN 'que' ELSE 'ung' END AS keyword, c_custkey % 3 = 0 AS alert_daily FROM customer""",
    "users": """SELECT c_custkey AS user_id, 'u' || CAST(c_custkey AS VARCHAR(20)) || '@example.com' AS email, CASE c_custkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'business' END AS plan, c_custkey % 7 <> 0 AS is_active, c_custkey % 5 <> 0 AS email_enabled FROM customer""",
    "plans": """SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderkey % 3 WHEN 0 THEN 'pro' ELSE 'business' END AS plan, CASE WHEN o_orderkey % 4 = 0 THEN 'cancelled' ELSE 'active' END AS status, @sec(1706659200, ((o_orderkey * 7) % 61 - 30) * 86400) AS expires_at FROM orders""",
    "brands": """SELECT s_suppkey AS id, s_suppkey % 9 AS user_id, 'brand' || CAST(s_suppkey AS VARCHAR(20)) AS brand_name, @list('k' || CAST(s_suppkey % 13 AS VARCHAR(20)), 'k' || CAST((s_suppkey * 5) % 13 AS VARCHAR(20))) AS keywords, s_suppkey % 6 <> 0 AS is_active,
        CASE WHEN s_suppkey % 4 = 0 THEN @sec(1706659200, 0 - s_suppkey * 3600) END AS last_alerted_at FROM supplier""",
    "mentions": """SELECT (conv_id * 7 + turn) % 97 AS brand_id, CASE WHEN conv_id % 4 = 0 THEN 'good ' || text WHEN conv_id % 4 = 1 THEN 'bad fail ' || text ELSE text END AS text FROM conversations""",
    "audit": """SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'login' WHEN 'O' THEN 'update' ELSE 'delete' END AS action, @sec(1706659200, 0 - (o_orderkey % 200) * 86400) AS created_at FROM orders""",
    "jobs": """SELECT event_id AS id, 'g' || CAST(event_id AS VARCHAR(20)) AS group_id, @sec(1706659200, 0 - (event_id * 13) % 40000) AS triggered_at, CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE 'running' END AS status FROM events""",
    "snapshots": """SELECT 'g' || CAST(event_id % 23 AS VARCHAR(20)) AS group_id, 'k' || CAST(event_id % 17 AS VARCHAR(20)) AS keyword, event_id % 31 AS frequency, @sec(1706659200, 0 - (event_id % 29) * 21600) AS snapshot_at FROM events""",
    "history": """SELECT 'k' || CAST(event_id % 13 AS VARCHAR(20)) AS keyword, @sec(1706659200, 0 - (event_id % 400) * 86400 - event_id) AS ts, CAST(event_id % 11 AS DOUBLE) AS value, event_id FROM events""",
    "alerts": """SELECT 's' || CAST(user_id % 5 AS VARCHAR(20)) AS service, event_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'error'""",
    "vectors": """SELECT v.vec_id AS article_id, v.embedding AS embedding, substr(d.text, 1, v.vec_id % 60) AS text, v.label AS cluster_id, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.source END AS source_type, @sec(1706486400, (v.vec_id * 7919) % 172800) AS published_at FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id""",
}



def _spark_sql(text: str) -> str:
    text = re.sub(r"@list\(", "array(", text)
    return _seconds(text, lambda base, n: f"timestamp'{_stamp(base)}' + make_dt_interval(0, 0, 0, {n})")


def _duck_sql(text: str) -> str:
    text = re.sub(r"@list\(", "list_value(", text)
    return _seconds(text, lambda base, n: f"(TIMESTAMP '{_stamp(base)}' + to_seconds({n}))")


def _stamp(base: str) -> str:
    import datetime

    return datetime.datetime.fromtimestamp(int(base), datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")


def _seconds(text: str, write) -> str:
    while (at := text.find("@sec(")) >= 0:
        depth, k = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        base, _, n = text[at + 5 : k - 1].partition(",")
        text = text[:at] + write(base.strip(), n.strip()) + text[k:]
    return text


def duck_with(text: str) -> str:
    """``text`` with the views it names in front, as DuckDB SQL."""
    used = [name for name in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text)]
    if not used:
        return text
    ctes = ", ".join(f"{name} AS ({_duck_sql(VIEWS[name])})" for name in used)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text)
    if head:
        return f"WITH {head[1] or ''}{ctes}, {text[head.end():]}"
    return f"WITH {ctes} {text}"


class Tables:
    """The views over one folder of test tables, as attributes; also the tables themselves."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = small_batches(shipped(spark)), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = _spark_sql(VIEWS[name]).replace("{", "{{").replace("}", "}}")
        used = {t for t in ("documents", "events", "pages", "conversations", "customer", "supplier", "orders", "embeddings") if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)}
        text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", text)
        tables = {t: getattr(self, t) for t in used}
        if name == "vectors":  # takes 59 characters of a text at most, so whole ones need not go through its join
            tables["documents"] = tables["documents"].withColumn("text", F.substring("text", 1, 60))
        return self.spark.sql(text, **tables)
