"""The registered queries over the test tables, by operator, with their SQL for DuckDB where SQL can express them.

An entry is ``ID_name: (query of Tables, SQL or None)``. SQL names the views of :mod:`tidewatch.adapters`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.adapters import AS_OF, Tables, duck_with
from tidewatch.functions import text as T
from tidewatch.operators import behavior as H
from tidewatch.operators import clusters as E
from tidewatch.operators import communities as M
from tidewatch.operators import dedupe as C
from tidewatch.operators import feeds as G
from tidewatch.operators import keywords as D
from tidewatch.operators import scoring as S
from tidewatch.operators import series as R
from tidewatch.params import Similarity
from tidewatch.runtime import written
from tidewatch.sources import search_index as N
from tidewatch.sources import stored as K
from tidewatch.sources import tables as A

ENTRIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}
NOW = f"TIMESTAMP '{AS_OF}'"
FP = "substr(sha256(coalesce(title, '') || substr(coalesce(body, ''), 1, 200)), 1, 16)"
HASHED = f"hashed AS (SELECT *, substr(sha256(url), 1, 16) AS url_hash, {FP} AS content_fp FROM articles)"


def stamp(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def dstamp(col: str, name: str | None = None) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S') AS {name or col}"


def r6(col: str, name: str | None = None):
    return F.round(F.col(col).cast("double"), 6).alias(name or col)


def fast_r6(col: str):
    """:func:`r6` of a double column: away from ties the nearest millionth is the same, without decimals row by row."""
    y = F.col(col) * 1e6
    tie = F.abs(y - F.floor(y) - 0.5) <= 1e-6
    return F.when(tie | (F.abs(y) >= 1e9), F.round(col, 6)).otherwise((F.rint(y) + 0.0) / 1e6).alias(col)


def add(name: str, sql: str | None = None):
    def keep(f: Callable[[Tables], DataFrame]):
        ENTRIES[name] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duck_with(sql) for name, (_, sql) in ENTRIES.items() if sql}


# Sources and sinks


@add("A1_pending_articles", f"SELECT article_id, {dstamp('publish_time')} FROM articles WHERE group_id IS NULL")
def _(t):
    return A.pending_articles(t.articles).select("article_id", stamp("publish_time"))


@add("A2_entries_to_articles", f"""SELECT page_id, trim(link) AS url, trim(e.title) AS title, substr(sha256(trim(link)), 1, 16) AS url_hash, {dstamp(f"coalesce(published, updated, {NOW})", 'publish_time')}, f.name AS source, coalesce(f.category, 'general') AS category
FROM entries e LEFT JOIN feeds f ON f.id = e.feed_id WHERE trim(link) <> '' AND trim(e.title) <> ''""")
def _(t):
    return A.entries_to_articles(t.entries, t.feeds, AS_OF).select("page_id", "url", "title", "url_hash", stamp("publish_time"), "source", "category")


#: White space, as Unicode has it, for RE2; entities that the pages have, ``&amp;`` last.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ENTITIES = {"&quot;": '"', "&#39;": "''", "&lt;": "<", "&gt;": ">", "&nbsp;": "\u00a0", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def unescaped(x: str) -> str:
    for name, to in ENTITIES.items():
        x = f"replace({x}, '{name}', '{to}')"
    return x


def _page_text_sql() -> str:
    x = "regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->', chr(1), 'g')"
    for tag in ("script", "style", "nav", "footer", "header", "aside", "iframe", "noscript"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?(</{tag}[^>]*>|\z)', chr(1), 'g')"
    parts = f"list_transform(string_split(regexp_replace({x}, '(?s)<[^>]*>', chr(1), 'g'), chr(1)), lambda d: regexp_replace({unescaped('d')}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))"
    return f"SELECT page_id, CASE WHEN length(x) >= 50 THEN x ELSE '' END AS text FROM (SELECT page_id, array_to_string(list_filter({parts}, lambda d: d <> ''), chr(10)) AS x FROM pages)"


@add("A3_html_to_text", f"SELECT page_id, CAST(length(text) AS INTEGER) AS n, sha256(text) AS text_sha256 FROM ({_page_text_sql()})")
def _(t):
    return A.html_to_text(t.pages.select("page_id", "html")).select("page_id", F.length("text").alias("n"), F.sha2("text", 256).alias("text_sha256"))


@add("A4_reddit_to_trends", """SELECT 'Post ' || CAST(event_id AS VARCHAR) AS keyword, CASE event_id % 3 WHEN 0 THEN 'it' WHEN 1 THEN 'sports' ELSE 'general' END AS category, CAST(event_id % 50 AS DOUBLE) AS score, 1706600000 + event_id AS epoch FROM events WHERE event_id % 9 <> 0""")
def _(t):
    raw = t.events.select(F.format_string('{"data":{"children":[{"data":{"title":"%s","subreddit":"%s","score":%d,"created_utc":%d}}]}}', F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.concat(F.lit("Post "), F.col("event_id"))), F.element_at(F.array(F.lit("technology"), F.lit("sports"), F.lit("unknown")), (F.col("event_id") % 3 + 1).cast("int")), F.col("event_id") % 50, F.col("event_id") + 1706600000).alias("json"))
    return A.reddit_to_trends(raw).select("keyword", "category", "score", F.unix_timestamp("snapshot_at").alias("epoch"))


@add("A5_videos_to_trends", """SELECT 'Video ' || CAST(event_id AS VARCHAR) AS keyword, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(event_id * 3 AS DOUBLE) END AS score FROM events""")
def _(t):
    raw = t.events.select(F.format_string('{"items":[{"id":"v%d","snippet":{"title":"Video %d"},"statistics":{"viewCount":"%s"}}]}', "event_id", "event_id", F.when(F.col("event_id") % 4 == 0, "n/a").otherwise((F.col("event_id") * 3).cast("string"))).alias("json"))
    return A.videos_to_trends(raw).select("keyword", "score")


@add("A6_searches_to_trends", """SELECT 'q' || CAST(page_id AS VARCHAR) AS keyword, CASE WHEN page_id % 5 = 0 THEN 0.0 ELSE CAST(page_id * 1000 AS DOUBLE) END AS score FROM pages""")
def _(t):
    rows = t.pages.select(F.concat(F.lit("q"), F.col("page_id")).alias("title"), F.when(F.col("page_id") % 5 == 0, "N/A").otherwise(F.concat(F.format_number(F.col("page_id") * 1000, 0), F.lit("+"))).alias("traffic"), F.lit("en").alias("locale"), F.lit(None).cast("timestamp").alias("published"))
    return A.searches_to_trends(rows).select("keyword", "score")


@add("A7_interest_score", "SELECT keyword, round(coalesce(avg(CASE WHEN value <> 0 THEN value END), 0), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY ts DESC, event_id DESC) AS n FROM history) WHERE n <= 7 GROUP BY keyword")
def _(t):
    return A.interest_score(t.history).select("keyword", r6("score"))


UPSERTED = "SELECT platform, keyword, locale, id FROM sns QUALIFY row_number() OVER (PARTITION BY platform, keyword, locale ORDER BY snapshot_at DESC, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END DESC, id DESC) = 1"


@add("A8_upsert_trends", UPSERTED)
def _(t):
    s = t.sns
    return A.upsert_trends(s.filter("id % 2 = 1"), s.filter("id % 2 = 0")).select("platform", "keyword", "locale", "id")


@add("A8_upsert_stored", UPSERTED)
def _(t):
    """The odd rows stored, the even ones upserted twice."""
    path, s = stream_path(t), t.sns
    for rows in (s.filter("id % 2 = 1"), s.filter("id % 2 = 0"), s.filter("id % 2 = 0")):
        K.upsert_stored(rows, path)
    return t.spark.read.parquet(path).select("platform", "keyword", "locale", "id")


@add("A9_collect_trends", "SELECT platform, substr(keyword, 1, 500) AS keyword, coalesce(sentiment_badge, 'neutral') AS sentiment_badge, coalesce(category, 'general') AS category, count(*) AS n FROM (SELECT platform, keyword, sentiment_badge, category FROM sns UNION ALL SELECT platform, keyword, NULL, NULL FROM posts) GROUP BY ALL")
def _(t):
    return A.collect_trends(t.sns, t.posts).groupBy("platform", "keyword", "sentiment_badge", "category").agg(F.count(F.lit(1)).alias("n"))


ASSIGNED = f"WITH {HASHED}, new AS (SELECT url_hash, min('n' || CAST(article_id % 7 AS VARCHAR)) AS g FROM hashed WHERE article_id % 3 = 0 GROUP BY 1) SELECT article_id, coalesce(g, group_id) AS group_id FROM hashed LEFT JOIN new USING (url_hash)"


@add("A10_assign_groups", ASSIGNED)
def _(t):
    a = T.with_hashes(t.articles)
    new = a.filter("article_id % 3 = 0").select("url_hash", F.concat(F.lit("n"), F.col("article_id") % 7).alias("group_id"))
    return A.assign_groups(a, new).select("article_id", "group_id")


@add("A10_assign_stored", ASSIGNED)
def _(t):
    path, a = stream_path(t), T.with_hashes(t.articles)
    K.put_partitions(a.withColumn("publish_date", F.to_date("publish_time")), path, "publish_date")
    K.assign_stored(a.filter("article_id % 3 = 0").select("url_hash", F.concat(F.lit("n"), F.col("article_id") % 7).alias("group_id")), path)
    return t.spark.read.parquet(path).select("article_id", "group_id")


@add("A11_export_trends", "SELECT id, title, category, locale, score, early_trend_score, array_to_string(keywords, '|') AS keywords, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM groups")
def _(t):
    return A.export_trends(t.groups)


@add("A12_materialize_feeds", """SELECT category, locale, count(*) AS items, '[' || string_agg('{"title":"' || title || '","score":' || CAST(score AS VARCHAR) || ',"keywords":["' || array_to_string(keywords, '","') || '"]}', ',' ORDER BY n) || ']' AS feed
FROM (SELECT *, row_number() OVER (PARTITION BY category, locale ORDER BY score DESC, id) AS n FROM groups) WHERE n <= 100 GROUP BY 1, 2""")
def _(t):
    return A.materialize_feeds(t.groups)


@add("A13_ingest_events", "SELECT user_id, event_type AS action, CAST(NULL AS VARCHAR) AS item_id, coalesce(props, '{}') AS meta, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    rows = A.ingest_events(t.events.select("user_id", F.col("event_type").alias("action"), F.col("props").alias("meta"), F.col("ts").alias("created_at")))
    return rows.groupBy("user_id", "action", "item_id", "meta").agg(F.count(F.lit(1)).alias("n"))


# Text


def normal_sql(column: str, table: str, key: str) -> str:
    """``table`` (key, x) with its column normalised, step by step; a sign is dropped where the two before it are the same."""
    steps = [(r"(?i)https?://[^\t\n\x0B\f\r <>\"'')\]]+", ""), (r"(?i)[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", ""), (rf"[^\pL\pN_{SPACE}.,!?;:()\"''\-–—…·]", " ")]
    plain = unescaped(f"coalesce({column}, '')")
    out = f"nfc_normalize(regexp_replace({plain}, '<[^>]+>', '', 'g'))"
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    kept = "array_to_string(list_filter(c, lambda e, i: e = chr(10) OR i < 3 OR NOT (c[i - 1] = e AND c[i - 2] = e)), '')"
    return f"SELECT {key}, trim(regexp_replace({kept}, '[{SPACE}]+', ' ', 'g'), ' ') AS x FROM (SELECT {key}, regexp_extract_all({out}, '(?s).') AS c FROM {table})"


def title_sql(x: str) -> str:
    for pattern in (rf"^[\[(【].*?[】\])][{SPACE}]*", rf"[{SPACE}]*[\[(]\p{{Nd}}+[\])][{SPACE}]*$", rf"[{SPACE}]+\p{{Nd}}+[{SPACE}]*$", rf"(?i)[{SPACE}]*[\[(]\.[a-z0-9]{{1,6}}[\])][{SPACE}]*$"):
        x = f"regexp_replace({x}, '{pattern}', '')"
    return f"trim({x}, ' ')"


TITLES = f"titles AS (SELECT article_id, {title_sql('x')} AS title FROM ({normal_sql('title', 'articles', 'article_id')}))"


@add("B1_normalize_text", f"SELECT page_id, CAST(length(x) AS INTEGER) AS n, sha256(x) AS text_sha256 FROM ({normal_sql('html', 'pages', 'page_id')})")
def _(t):
    return t.pages.select("page_id", T.normalize_text(F.col("html")).alias("x")).select("page_id", F.length("x").alias("n"), F.sha2("x", 256).alias("text_sha256"))


@add("B2_normalize_title", f"WITH {TITLES} SELECT article_id, title FROM titles")
def _(t):
    return t.articles.select("article_id", T.normalize_title(F.col("title")).alias("title"))


@add("B3_normalize_articles", f"WITH {TITLES} SELECT article_id, title, sha256(x) AS body_sha256 FROM titles JOIN ({normal_sql('body', 'articles', 'article_id')}) USING (article_id) WHERE title <> ''")
def _(t):
    return T.normalize_articles(t.articles).select("article_id", "title", F.sha2("body", 256).alias("body_sha256"))


@add("B4_repair_titles", """WITH x AS (SELECT page_id, rtrim(regexp_replace(CASE WHEN page_id % 2 = 0 THEN '"Title" ' || CAST(page_id AS VARCHAR) ELSE 'Plain" ' || CAST(page_id AS VARCHAR) END, ' [0-9]+$', '')) AS t FROM pages) SELECT page_id, CASE WHEN t LIKE '"%"' THEN trim(t, '"') ELSE t END AS title FROM x""")
def _(t):
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('"Title" '), F.col("page_id"))).otherwise(F.concat(F.lit('Plain" '), F.col("page_id"))).alias("title"))
    return T.repair_titles(rows)


@add("B5_drop_numeric_keywords", "SELECT id, array_to_string(list_filter(keywords, lambda k: NOT regexp_full_match(k, '[0-9]+')), '|') AS keywords FROM groups")
def _(t):
    return T.drop_numeric_keywords(t.groups).select("id", F.array_join("keywords", "|").alias("keywords"))


@add("B6_hashes", f"WITH {HASHED} SELECT article_id, url_hash, content_fp FROM hashed")
def _(t):
    return T.with_hashes(t.articles).select("article_id", "url_hash", "content_fp")


WORDS = [("sports", "th", 1.5), ("sports", "ing", 1.0), ("economy", "que", 1.5), ("economy", "ción", 1.5), ("tech", "ung", 1.6), ("tech", "sch", 1.6), ("sports", "tion", 1.0)]


def sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@add("B7_infer_category", f"""WITH dict(class, word, weight) AS (VALUES {sql_rows(WORDS)}), hits AS (SELECT article_id, class, sum(weight) AS w FROM articles JOIN dict ON contains(lower(coalesce(title, '') || ' ' || substr(coalesce(body, ''), 1, 200)), word) GROUP BY 1, 2),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY round(w, 6) DESC, class) = 1) SELECT article_id, CASE WHEN w >= 3.0 THEN class ELSE category END AS category FROM articles LEFT JOIN best USING (article_id)""")
def _(t):
    words = t.spark.createDataFrame(WORDS, "category string, keyword string, weight double")
    return T.infer_category(t.articles, words).select("article_id", "category")


SPAM_SQL = f"""f AS (SELECT *, list_sum(list_transform(regexp_extract_all(x, '(?i)https?://[^\\s]+'), lambda u: length(u))) AS u, list_sum(list_transform(regexp_extract_all(x, '[A-Z]{{10,}}'), lambda u: length(u))) AS c,
{' + '.join(f"CAST(contains(lower(x), '{w}') AS INTEGER)" for w in T.SPAM_WORDS)} AS hits, len(regexp_extract_all(x, '0\\d{{1,2}}[-.\\s]?\\d{{3,4}}[-.\\s]?\\d{{4}}')) AS phones, len(regexp_extract_all(x, '[!?]{{3,}}')) AS specials, greatest(length(x), 1) AS n,
length(trim(x, ' ' || chr(9) || chr(10) || chr(13))) AS size FROM (SELECT article_id, title || ' ' || body AS x FROM articles)),
s AS (SELECT *, CASE WHEN size = 0 THEN 1.0 ELSE round(least(1.0, CASE WHEN regexp_matches(x, '\\d+월\\s*\\d+일\\s*(알림|인사|소식|안내|공지|일정|행사|메모)') THEN 0.5 ELSE 0 END + CASE WHEN size < 20 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(u, 0) / n > 0.3 THEN 0.3 ELSE 0 END + CASE WHEN hits >= 3 THEN 0.3 ELSE 0 END
 + CASE WHEN phones >= 2 THEN 0.2 ELSE 0 END + CASE WHEN coalesce(c, 0) / n > 0.3 THEN 0.1 ELSE 0 END + CASE WHEN specials >= 3 THEN 0.1 ELSE 0 END), 6) END AS confidence FROM f)"""


@add("B8_spam_features", f"WITH {SPAM_SQL} SELECT article_id, round(CAST(coalesce(u, 0) / n AS DOUBLE), 6) AS url_ratio, CAST(hits AS INTEGER) AS keyword_hits, CAST(phones AS INTEGER) AS phone_count, round(CAST(coalesce(c, 0) / n AS DOUBLE), 6) AS caps_ratio, CAST(specials AS INTEGER) AS special_count FROM s")
def _(t):
    return T.spam_features(t.articles.withColumn("text", F.concat_ws(" ", "title", "body"))).select("article_id", r6("url_ratio"), "keyword_hits", "phone_count", r6("caps_ratio"), "special_count")


@add("B9_classify_spam", f"WITH {SPAM_SQL} SELECT article_id, CAST(confidence AS DOUBLE) AS confidence, confidence >= 0.5 AS is_spam FROM s")
def _(t):
    return T.classify_spam(t.articles.withColumn("text", F.concat_ws(" ", "title", "body"))).select("article_id", "confidence", "is_spam")


@add("B10_filter_spam", f"WITH {SPAM_SQL} SELECT article_id FROM s WHERE confidence < 0.5")
def _(t):
    return T.filter_spam(t.articles).select("article_id")


OFF = ("casino", "stupid", "license", "copyright")


@add("B11_filter_off_topic", f"SELECT article_id FROM articles WHERE {' + '.join(f'''CAST(contains(lower(title || ' ' || body), '{w}') AS INTEGER)''' for w in OFF)} < 2")
def _(t):
    return T.filter_off_topic(t.articles, OFF).select("article_id")


@add("B12_spam_model")
def _(t):
    from tidewatch.functions.models import spam_model

    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "text", (1 - F.col("quality")).alias("label"))
    return spam_model(rows.filter("label is not null"), rows).select("doc_id", "spam_probability")


def _stems(words) -> str:
    return " + ".join(f"CAST(contains(x, '{w}') AS INTEGER)" for w in words)


SENT = f"CASE WHEN p > q THEN 'positive' WHEN q > p THEN 'negative' ELSE 'neutral' END"
SENTIMENT = f"{_stems(T.POSITIVE)} AS p, {_stems(T.NEGATIVE)} AS q"


@add("B13_sentiment", f"SELECT brand_id, {SENT} AS label, round(least(1.0, CAST(greatest(p, q) AS DOUBLE) / greatest(len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')), 1)), 6) AS sentiment FROM (SELECT *, {SENTIMENT} FROM (SELECT brand_id, lower(text) AS x FROM mentions))")
def _(t):
    return T.sentiment(t.mentions).select("brand_id", "label", r6("sentiment"))


QUESTION = "(contains(lower(keyword), '?') OR regexp_extract(lower(keyword), '^\\s*(\\S+)', 1) IN ('how','why','what','when','where','which','who') OR " + " OR ".join(f"contains(keyword, '{w}')" for w in T.QUESTION_IN) + ")"


@add("B14_is_question", f"SELECT id, {QUESTION} AS question FROM posts")
def _(t):
    return t.posts.select("id", T.is_question(F.col("keyword")).alias("question"))


@add("B15_textrank", r"""WITH top AS (SELECT group_id, body, row_number() OVER (PARTITION BY group_id ORDER BY publish_time DESC, article_id) AS r FROM articles WHERE group_id IS NOT NULL), txt AS (SELECT group_id, string_agg(substr(body, 1, 500), ' ' ORDER BY r) AS t FROM top WHERE r <= 5 GROUP BY 1),
p AS (SELECT group_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM txt), s AS (SELECT group_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM p), w AS (SELECT *, list_distinct(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+')) AS w FROM s),
r AS (SELECT x.group_id, x.i, x.s, round(sum(CASE WHEN x.i = y.i THEN 0 ELSE len(list_intersect(x.w, y.w)) / greatest(len(list_distinct(list_concat(x.w, y.w))), 1) END), 9) AS sc FROM w x JOIN w y USING (group_id) GROUP BY 1, 2, 3), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY sc DESC, i) <= 5)
SELECT group_id, string_agg(s, ' ' ORDER BY i) AS summary FROM b GROUP BY 1""".replace("\\\\", "\\"))
def _(t):
    return T.group_summaries(t.articles)


@add("B16_grounding_gate", """WITH g AS (SELECT conv_id, text FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id, text FROM conversations WHERE role <> 'assistant'),
gw AS (SELECT DISTINCT conv_id, id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM (SELECT conv_id, text, conv_id * 1000 + turn AS id FROM conversations WHERE role = 'assistant')),
sw AS (SELECT DISTINCT conv_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM s),
r AS (SELECT id, any_value(gw.conv_id) AS conv_id, CAST(count(sw.w) AS DOUBLE) / count(*) AS recall FROM gw LEFT JOIN sw ON gw.conv_id = sw.conv_id AND gw.w = sw.w GROUP BY id), su AS (SELECT conv_id, list('c' || conv_id || 't' || turn) AS urls FROM conversations WHERE role <> 'assistant' GROUP BY 1)
SELECT id, round(recall, 6) AS recall, recall >= 0.05 AS grounded, array_to_string(list_filter(['c' || r.conv_id || 't0', 'c' || r.conv_id || 't1', 'elsewhere'], lambda u: list_contains(coalesce(urls, []), u)), '|') AS cited FROM r LEFT JOIN su ON su.conv_id = r.conv_id""".replace("\\\\s", "\\s"))
def _(t):
    c = t.conversations
    g = c.filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "text", F.array(F.format_string("c%dt0", "conv_id"), F.format_string("c%dt1", "conv_id"), F.lit("elsewhere")).alias("cited"))
    s = g.select("id", "conv_id").join(c.filter("role <> 'assistant'").select("conv_id", "text", F.format_string("c%dt%d", "conv_id", "turn").alias("url")), "conv_id").select("id", "text", "url")
    return T.grounding_gate(g.select("id", "text", "cited"), s, "id").select("id", "recall", "grounded", F.array_join("cited", "|").alias("cited"))


# De-duplication

DEDUPED = f"{HASHED}, u AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY article_id) = 1), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY content_fp ORDER BY article_id) = 1)"


@add("C1_dedupe_batch", f"WITH {DEDUPED} SELECT article_id FROM d")
def _(t):
    return C.dedupe_batch(T.with_hashes(t.articles)).select("article_id")


@add("C2_drop_seen", f"WITH {HASHED}, seen AS (SELECT url_hash, content_fp FROM hashed WHERE article_id % 4 = 0) SELECT article_id FROM hashed WHERE url_hash NOT IN (SELECT url_hash FROM seen) AND content_fp NOT IN (SELECT content_fp FROM seen)")
def _(t):
    a = T.with_hashes(t.articles)
    return C.drop_seen(a, a.filter("article_id % 4 = 0")).select("article_id")


@add("C3_duplicate_groups", f"WITH {HASHED} SELECT content_fp, count(*) AS copies, min(article_id) AS kept_id FROM hashed GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return C.duplicate_groups(T.with_hashes(t.articles))


# Keywords

STOP_LIST = "[" + ", ".join(f"'{w}'" for w in D.STOP) + "]"


def toks(x: str) -> str:
    return f"list_filter(list_concat(regexp_extract_all({x}, '[가-힣]{{2,}}'), list_transform(regexp_extract_all({x}, '[a-zA-Z]{{2,}}'), lambda w: lower(w))), lambda w: length(w) <= 30 AND NOT list_contains({STOP_LIST}, w))"


TERMS = f"""title_terms AS (SELECT article_id, unnest({toks('title')}) AS term FROM articles), body_terms AS (SELECT article_id, unnest({toks("substr(coalesce(body, ''), 1, 500)")}) AS term FROM articles),
terms AS (SELECT article_id, term, CAST(sum(n) AS BIGINT) AS tf FROM (SELECT article_id, term, count(*) * 2 AS n FROM title_terms GROUP BY 1, 2 UNION ALL SELECT article_id, term, count(*) FROM body_terms GROUP BY 1, 2) x GROUP BY 1, 2)"""
SCORES = f"""{TERMS}, lens AS (SELECT article_id, sum(tf) AS n FROM terms GROUP BY 1), stats AS (SELECT count(*) AS docs, avg(n) AS mean_n FROM lens), dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY 1),
idfs AS (SELECT term, ln((docs - df + 0.5) / (df + 0.5) + 1) AS idf, mean_n FROM dfs, stats),
scores AS (SELECT article_id, term, tf, CAST(tf AS DOUBLE) / n * idf * (idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / mean_n))) AS score FROM terms JOIN lens USING (article_id) JOIN idfs USING (term))"""


@add("D1_tokenize", f"SELECT article_id, array_to_string({toks('body')}, ' ') AS tokens FROM articles")
def _(t):
    return t.articles.select("article_id", F.array_join(D.tokenize(F.col("body")), " ").alias("tokens"))


CORPUS = f"WITH {TERMS}, lens AS (SELECT article_id, sum(tf) AS n FROM terms GROUP BY 1) SELECT term, count(*) AS df, (SELECT count(*) FROM lens) AS docs, (SELECT round(avg(n), 6) FROM lens) AS mean_n FROM terms GROUP BY 1"


@add("D2_corpus_stats", CORPUS)
def _(t):
    df, stats = D.corpus_stats(D._terms(t.articles, 2.0, 500))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", "docs", r6("mean_n"))  # one row


@add("D2_running_stats", CORPUS)
def _(t):
    """The articles as three batches, the second one twice."""
    path = stream_path(t)
    for n in (0, 1, 1, 2):
        df, stats = D.running_stats(D._terms(t.articles.filter(F.col("article_id") % 3 == n), 2.0, 500), path, n)
    return df.crossJoin(F.broadcast(stats)).select("term", "df", "docs", r6("mean_n"))  # one row


@add("D3_keyword_scores", f"WITH {SCORES} SELECT article_id, term, tf, round(score, 6) AS score FROM scores")
def _(t):
    return D.keyword_scores(t.articles).select("article_id", "term", "tf", r6("score"))


KEYWORDS = f"{SCORES}, kw AS (SELECT article_id, string_agg(term, '|' ORDER BY r) AS keywords, max(score) AS keyword_importance FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(score, 9) DESC, term) AS r FROM scores) WHERE r <= 10 GROUP BY 1)"


@add("D4_extract_keywords", f"WITH {KEYWORDS} SELECT article_id, keywords, round(keyword_importance, 6) AS keyword_importance FROM kw")
def _(t):
    return D.extract_keywords(t.articles).select("article_id", F.array_join("keywords", "|").alias("keywords"), r6("keyword_importance"))


@add("D5_bigrams", f"""WITH tk AS (SELECT article_id, {toks('body')} AS t FROM articles), pairs AS (SELECT article_id, unnest(list_zip(t[1:len(t) - 1], t[2:])) AS p FROM tk WHERE len(t) > 1),
two AS (SELECT article_id, p[1] AS a, p[2] AS b, count(*) AS freq FROM pairs WHERE p[1] <> p[2] GROUP BY 1, 2, 3 HAVING count(*) >= 2), one AS (SELECT article_id, w, CAST(count(*) AS DOUBLE) / max(n) AS share FROM (SELECT article_id, unnest(t) AS w, len(t) AS n FROM tk) GROUP BY 1, 2)
SELECT two.article_id, a || '_' || b AS bigram, freq, round(0.5 * (x.share + y.share) / 2, 6) AS score FROM two JOIN one x ON x.article_id = two.article_id AND x.w = a JOIN one y ON y.article_id = two.article_id AND y.w = b""")
def _(t):
    return D.bigrams(t.articles).select("article_id", "bigram", "freq", r6("score"))


def tagged(t: Tables) -> DataFrame:
    rows = t.articles.select("article_id", "group_id", "title", "body")
    return written(rows.select("article_id", "group_id").join(D.extract_keywords(rows), "article_id"), "tagged")


KW_ROWS = f"{KEYWORDS}, ak AS (SELECT DISTINCT group_id, article_id, unnest(string_split(keywords, '|')) AS keyword FROM articles JOIN kw USING (article_id) WHERE group_id IS NOT NULL)"


@add("D6_group_keywords", f"WITH {KW_ROWS}, c AS (SELECT group_id, keyword, count(*) AS articles FROM ak WHERE length(keyword) > 1 GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY articles DESC, keyword) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY articles DESC, keyword) <= 20".replace("AS articles FROM ak", "AS articles FROM ak"))
def _(t):
    return D.group_keywords(tagged(t))


NODES = f"{KW_ROWS}, c AS (SELECT group_id, keyword, count(*) AS frequency FROM ak GROUP BY 1, 2), nodes AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY frequency DESC, keyword) <= 30)"


@add("D7_keyword_nodes", f"WITH {NODES} SELECT group_id, keyword, frequency, round(CAST(frequency AS DOUBLE) / max(frequency) OVER (PARTITION BY group_id), 6) AS score FROM nodes")
def _(t):
    return D.keyword_nodes(tagged(t)).select("group_id", "keyword", "frequency", r6("score"))


@add("D8_keyword_edges", f"""WITH {NODES}, r AS (SELECT ak.*, frequency FROM ak JOIN nodes USING (group_id, keyword)), e AS (SELECT x.group_id, x.keyword AS source, y.keyword AS target, CAST(count(*) AS DOUBLE) / (max(x.frequency) + max(y.frequency) - count(*)) AS weight FROM r x JOIN r y ON x.group_id = y.group_id AND x.article_id = y.article_id AND x.keyword < y.keyword GROUP BY 1, 2, 3)
SELECT group_id, source, target, round(weight, 6) AS weight FROM e WHERE weight >= 0.1 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY weight DESC, source, target) <= 50""")
def _(t):
    return D.keyword_edges(tagged(t)).select("group_id", "source", "target", r6("weight"))


@add("D9_keyword_snapshot", f"SELECT id AS group_id, unnest(keywords[1:10]) AS keyword, 1 AS frequency FROM (SELECT * FROM groups WHERE created_at > {NOW} - INTERVAL 24 HOURS ORDER BY score DESC, id LIMIT 500)")
def _(t):
    return D.keyword_snapshot(t.groups, AS_OF).select("group_id", "keyword", "frequency")


@add("D10_keyword_history", f"""WITH r AS (SELECT group_id, snapshot_at, keyword, max(frequency) AS frequency FROM snapshots GROUP BY 1, 2, 3), d AS (SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY snapshot_at DESC) AS t, row_number() OVER (PARTITION BY group_id, snapshot_at ORDER BY frequency DESC, keyword) AS r FROM r)
SELECT group_id, {dstamp('snapshot_at')}, string_agg(keyword, '|' ORDER BY r) AS keywords FROM d WHERE t <= 10 AND r <= 10 GROUP BY group_id, d.snapshot_at""")
def _(t):
    return D.keyword_history(t.snapshots).select("group_id", stamp("snapshot_at"), F.array_join("keywords", "|").alias("keywords"))


@add("D11_keyword_batches", f"SELECT keyword, CAST(floor((row_number() OVER (ORDER BY keyword) - 1) / 5) AS INTEGER) AS batch FROM (SELECT DISTINCT unnest(keywords) AS keyword FROM groups WHERE created_at > {NOW} - INTERVAL 24 HOURS) WHERE length(keyword) > 1 ORDER BY keyword LIMIT 50")
def _(t):
    return D.keyword_batches(t.groups, AS_OF)


# Similarity and clusters


def group_classes(t: Tables) -> tuple[DataFrame, DataFrame]:
    return E.keyword_classes(t.groups, "id", 0.2, ["category"])


PAIRS = "gk AS (SELECT id, category, title, score, list_distinct(keywords) AS k FROM groups), pairs AS (SELECT x.category, x.id AS a, y.id AS b, CAST(len(list_intersect(x.k, y.k)) AS DOUBLE) / len(list_distinct(list_concat(x.k, y.k))) AS jaccard FROM gk x JOIN gk y ON x.category = y.category AND x.id < y.id)"


#: Pairs between the smallest groups of equal keyword sets, and those with the others of their sets.
CLASSES = "cl AS (SELECT id, min(id) OVER (PARTITION BY category, list_sort(k)) AS rep FROM gk)"


@add("E1_jaccard", f"WITH {PAIRS}, {CLASSES} SELECT category, a, b, round(jaccard, 6) AS jaccard FROM pairs JOIN cl x ON x.id = a JOIN cl y ON y.id = b WHERE jaccard >= 0.2 AND (x.rep = a AND y.rep = b OR y.rep = a)")
def _(t):
    return E.class_links(*group_classes(t)).select("category", "a", "b", r6("jaccard"))


@add("E2_cosine", "SELECT x.vec_id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def _(t):
    from tidewatch.functions.similarity import cosine

    e = t.embeddings.select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@add("E3_time_and_source", "SELECT x.article_id, round(exp(-abs(epoch(x.published_at) - epoch(y.published_at)) / 3600 / 24), 6) AS time_sim, CASE WHEN x.source_type IS NULL OR y.source_type IS NULL THEN 0.5 WHEN x.source_type = y.source_type THEN 1.0 ELSE 0.0 END::DOUBLE AS source_sim FROM vectors x JOIN vectors y ON y.article_id = x.article_id + 1")
def _(t):
    from tidewatch.functions.similarity import source_sim, temporal_sim

    v = t.vectors.select("article_id", "published_at", "source_type")
    w = v.select((F.col("article_id") - 1).alias("article_id"), F.col("published_at").alias("p"), F.col("source_type").alias("s"))
    return v.join(w, "article_id").select("article_id", F.round(temporal_sim(F.col("published_at"), F.col("p")), 6).alias("time_sim"), source_sim(F.col("source_type"), F.col("s")).alias("source_sim"))


def items(t: Tables) -> DataFrame:
    k = F.transform(F.array(F.lit(7), F.lit(11), F.lit(13), F.lit(17)), lambda m: F.concat(F.lit("w"), m, F.lit("_"), F.col("article_id") % m))
    k = F.slice(k, F.lit(1), (F.col("article_id") % 3 + 2).cast("int"))
    return t.vectors.select(F.col("article_id").alias("item_id"), k.alias("keywords"), "published_at", "source_type", "embedding", "text")


def topic_items(t: Tables) -> DataFrame:
    """Vectors around topics of 16 items: half an item's own vector and the whole one of the topic's first item."""
    w = lambda c, n: F.concat(F.lit(c), F.floor(F.col("article_id") / n))
    k = F.array(w("a", 7), w("b", 11), w("c", 13), F.concat(F.lit("w"), F.col("article_id") % 7))
    k = F.slice(k, F.lit(1), (F.col("article_id") % 3 + 2).cast("int"))
    topic = t.embeddings.select(F.col("vec_id").alias("topic"), F.col("embedding").alias("centre"))
    rows = t.vectors.withColumn("topic", F.col("article_id") - F.col("article_id") % 16).join(topic, "topic")
    mixed = F.zip_with("embedding", "centre", lambda x, c: 0.5 * x.cast("double") + c.cast("double"))
    return rows.select(F.col("article_id").alias("item_id"), k.alias("keywords"), "published_at", "source_type", mixed.alias("embedding"), "text")


TOPIC_ITEMS = """items AS (SELECT article_id AS item_id, text, (['a' || article_id // 7, 'b' || article_id // 11, 'c' || article_id // 13, 'w' || article_id % 7])[1:2 + article_id % 3] AS k, published_at, source_type,
 list_transform(list_zip(v.embedding, c.embedding), lambda p: 0.5 * CAST(p[1] AS DOUBLE) + CAST(p[2] AS DOUBLE)) AS e FROM vectors v JOIN embeddings c ON c.vec_id = article_id - article_id % 16)"""
LOOSE = Similarity(threshold=0.25)
ITEMS = "items AS (SELECT article_id AS item_id, text, (['w7_' || (article_id % 7), 'w11_' || (article_id % 11), 'w13_' || (article_id % 13), 'w17_' || (article_id % 17)])[1:2 + article_id % 3] AS k, published_at, source_type, CAST(embedding AS DOUBLE[]) AS e FROM vectors)"
EDGES = f"""{ITEMS}, ed AS (SELECT x.item_id AS a, y.item_id AS b, 0.5 * list_cosine_similarity(x.e, y.e) + 0.25 * len(list_intersect(x.k, y.k)) / CAST(len(list_distinct(list_concat(x.k, y.k))) AS DOUBLE) + 0.15 * exp(-abs(epoch(x.published_at) - epoch(y.published_at)) / 86400)
 + 0.1 * CASE WHEN x.source_type IS NULL OR y.source_type IS NULL THEN 0.5 WHEN x.source_type = y.source_type THEN 1 ELSE 0 END AS weight FROM items x JOIN items y ON x.item_id < y.item_id), edges AS (SELECT * FROM ed WHERE weight >= 0.25)"""
TOPIC_EDGES = EDGES.replace(ITEMS, TOPIC_ITEMS).replace("weight >= 0.25", "weight >= 0.55")


@add("E4_similarity_edges", f"WITH {EDGES} SELECT a, b, round(weight, 6) AS weight FROM edges")
def _(t):
    return E.similarity_edges(items(t), LOOSE).select("a", "b", fast_r6("weight"))


@add("E5_match_groups", f"""WITH {KEYWORDS}, a AS (SELECT article_id, e, list_distinct(list_concat(CASE WHEN keywords IS NULL THEN [] ELSE string_split(keywords, '|') END, list_filter(string_split_regex(title, '\\s+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')))) AS wa
  FROM articles LEFT JOIN kw USING (article_id) LEFT JOIN (SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) USING (article_id) WHERE group_id IS NULL),
g AS (SELECT id, score, e, list_distinct(list_concat(keywords, list_filter(string_split_regex(title, '\\s+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')))) AS wg
  FROM groups LEFT JOIN (SELECT 'g' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) USING (id) WHERE created_at > {NOW} - INTERVAL 48 HOURS),
m AS (SELECT article_id, id AS group_id, score, round(0.5 * len(list_intersect(wa, wg)) / CAST(len(list_distinct(list_concat(wa, wg))) AS DOUBLE) + 0.5 * CASE WHEN a.e IS NULL OR g.e IS NULL THEN 0 ELSE list_cosine_similarity(a.e, g.e) END, 9) AS similarity FROM a JOIN g ON len(wa) > 0 AND len(wg) > 0)
SELECT article_id, group_id, round(similarity, 6) AS similarity FROM m WHERE similarity >= 0.12 QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY similarity DESC, score DESC, group_id) = 1""")
def _(t):
    v = t.embeddings.select("vec_id", "embedding")
    a = t.articles.filter("group_id is null").join(D.extract_keywords(t.articles), "article_id", "left").join(v.withColumnRenamed("vec_id", "article_id"), "article_id", "left")
    g = t.groups.join(v.select(F.concat(F.lit("g"), F.col("vec_id")).alias("id"), "embedding"), "id", "left")
    return E.match_groups(a, g, AS_OF, 0.12, 48).select("article_id", "group_id", r6("similarity"))


@add("E6_rescore_matched", "SELECT id, article_count, source_count, greatest(g.score, new_score) AS score, round(least(1.0, article_count / 10) * 0.4 + 0.3, 6) AS early_trend_score FROM groups g JOIN (SELECT group_id, count(*) AS article_count, count(DISTINCT source) AS source_count, CAST(max(article_id % 100) AS DOUBLE) AS new_score FROM articles WHERE group_id IS NOT NULL GROUP BY 1) n ON n.group_id = g.id")
def _(t):
    return E.rescore_matched(t.groups, t.articles.withColumn("score", (F.col("article_id") % 100).cast("double"))).select("id", "article_count", "source_count", "score", r6("early_trend_score"))


CLOSED = "reach AS (SELECT a AS n, a AS m FROM both_ UNION SELECT r.n, b.b AS m FROM reach r JOIN both_ b ON b.a = r.m), label AS (SELECT n, min(m) AS component FROM reach GROUP BY n)"


@add("E7_topic_clusters", f"WITH RECURSIVE {EDGES.replace('weight >= 0.25', 'weight >= 0.38')}, both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), {CLOSED} SELECT item_id, coalesce(component, item_id) AS cluster_id FROM items LEFT JOIN label ON n = item_id WHERE component IS NOT NULL OR (length(text) >= 20 AND len(k) >= 3)")
def _(t):
    it = items(t)
    return E.topic_clusters(it, E.similarity_edges(it, Similarity(threshold=0.38), forest=True))  # sparse enough for several clusters and noise


@add("E7_density_clusters", f"""WITH RECURSIVE {TOPIC_EDGES}, bo AS (SELECT a, b, weight FROM edges UNION ALL SELECT b, a, weight FROM edges), core AS (SELECT a AS c FROM bo GROUP BY 1 HAVING count(*) >= 3),
both_ AS (SELECT a, b FROM bo WHERE a IN (FROM core) AND b IN (FROM core)), {CLOSED}, cores AS (SELECT c, coalesce(component, c) AS cluster_id FROM core LEFT JOIN label ON n = c),
rim AS (SELECT a, arg_min(b, (-weight, b)) AS b FROM bo WHERE a NOT IN (FROM core) AND b IN (FROM core) GROUP BY 1), rest AS (SELECT * FROM bo WHERE a NOT IN (FROM core) AND b NOT IN (FROM core) AND a NOT IN (SELECT a FROM rim) AND b NOT IN (SELECT a FROM rim)),
best AS (SELECT a, arg_min(b, (-weight, b)) AS b FROM rest GROUP BY 1), found AS (SELECT c AS item, cluster_id, 'core' AS role FROM cores UNION ALL SELECT a, cluster_id, 'border' FROM rim JOIN cores ON c = b UNION ALL SELECT x.a, least(x.a, x.b), 'pair' FROM best x JOIN best y ON x.a = y.b AND x.b = y.a)
SELECT item_id, coalesce(cluster_id, item_id) AS cluster_id, coalesce(role, 'noise') AS role FROM items LEFT JOIN found ON item = item_id WHERE role IS NOT NULL OR (length(text) >= 20 AND len(k) >= 3)""")
def _(t):
    it = topic_items(t)
    return E.density_clusters(it, E.similarity_edges(it))


def _rounds(n: int) -> str:
    step = "l{k} AS (SELECT node, label FROM (SELECT node, label, round(sum(w), 9) AS w FROM (SELECT e.a AS node, l.label, e.weight AS w FROM bw e JOIN l{j} l ON l.node = e.b UNION ALL SELECT node, label, 1.0 FROM l{j}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, label) = 1)"
    return ", ".join(["bw AS (SELECT a, b, jaccard AS weight FROM pairs WHERE jaccard >= 0.2 UNION ALL SELECT b, a, jaccard FROM pairs WHERE jaccard >= 0.2)", "l0 AS (SELECT DISTINCT a AS node, a AS label FROM bw)", *(step.format(k=k, j=k - 1) for k in range(1, n + 1))])


@add("E8_communities", f"WITH {PAIRS}, {_rounds(5)} SELECT node, label AS community FROM l5")
def _(t):
    return E.class_communities(*group_classes(t))


@add("E8_label_modularity", f"WITH {PAIRS}, {_rounds(5)}, com AS (SELECT label, sum(weight) AS s FROM bw JOIN l5 ON node = a GROUP BY 1), inn AS (SELECT coalesce(sum(weight), 0) AS w FROM bw JOIN l5 x ON x.node = bw.a JOIN l5 y ON y.node = bw.b WHERE x.label = y.label) SELECT round(max(w) / sum(s) - sum(s * s) / (sum(s) * sum(s)), 6) AS modularity FROM com, inn")
def _(t):
    near, members = group_classes(t)
    return M.modularity(E.class_graph(near, members), E.class_communities(near, members)).select(r6("modularity"))


@add("E8_modularity")
def _(t):
    near, members = group_classes(t)
    label = M.modularity_communities(E.class_graph(near, members))
    return members.join(label, members.rep == label.node).select(members.id.alias("node"), "community")


CENTRE = "v AS (SELECT article_id, cluster_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors), cd AS (SELECT cluster_id, i, avg(x) AS x FROM (SELECT cluster_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY 1, 2), c AS (SELECT cluster_id, list(x ORDER BY i) AS centroid FROM cd GROUP BY 1), s AS (SELECT article_id, cluster_id, list_cosine_similarity(e, centroid) AS similarity FROM v JOIN c USING (cluster_id))"


@add("E9_representatives", f"WITH {CENTRE} SELECT cluster_id, article_id AS representative, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(similarity, 9) DESC, article_id) = 1")
def _(t):
    return E.representatives(t.vectors).select("cluster_id", "representative", r6("similarity"))


@add("E10_refine_clusters", f"WITH {CENTRE}, st AS (SELECT cluster_id, count(*) AS n, avg(similarity) - stddev_pop(similarity) AS low FROM s GROUP BY 1) SELECT article_id, CASE WHEN NOT (n >= 3 AND similarity < low - 1e-12) THEN cluster_id END AS cluster_id, round(similarity, 6) AS similarity, n >= 3 AND similarity < low - 1e-12 AS evicted FROM s JOIN st USING (cluster_id)")
def _(t):
    return E.refine_clusters(t.vectors).select("article_id", "cluster_id", r6("similarity"), "evicted")


@add("E11_silhouette", """WITH v AS (SELECT article_id, cluster_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors), d AS (SELECT x.article_id, x.cluster_id AS own, y.cluster_id AS other, sum(CASE WHEN x.article_id = y.article_id THEN 0 ELSE 1 - list_cosine_similarity(x.e, y.e) END) AS s, count(*) AS n FROM v x, v y GROUP BY 1, 2, 3),
m AS (SELECT article_id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1)
SELECT count(*) AS items, (SELECT count(DISTINCT cluster_id) FROM v) AS clusters, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""")
def _(t):
    return E.silhouette(t.vectors).select("items", "clusters", r6("silhouette"))


@add("E12_meta_trends", f"""WITH RECURSIVE {PAIRS}, both_ AS (SELECT a, b FROM pairs WHERE jaccard >= 0.2 UNION SELECT b, a FROM pairs WHERE jaccard >= 0.2), {CLOSED}
SELECT component, category, count(*) AS n, arg_min(title, (-score, id)) AS title, string_agg(id, '|' ORDER BY id) AS ids, round(sum(score), 6) AS score FROM label JOIN gk ON gk.id = label.n GROUP BY 1, 2""")
def _(t):
    return E.meta_trends(t.groups).select("component", "category", F.size("ids").cast("long").alias("n"), "title", F.array_join("ids", "|").alias("ids"), r6("score"))


@add("E13_group_titles", f"""WITH {KW_ROWS}, c AS (SELECT group_id, keyword, count(*) AS articles FROM ak WHERE length(keyword) > 1 AND NOT regexp_full_match(keyword, '[0-9]+') GROUP BY 1, 2), top AS (SELECT group_id, string_agg(keyword, ' · ' ORDER BY r) AS k FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY articles DESC, keyword) AS r FROM c) WHERE r <= 3 GROUP BY 1),
short AS (SELECT group_id, CASE WHEN group_id LIKE '%3' OR group_id LIKE '%5' THEN substr(title, 1, 3) ELSE title END AS title FROM articles WHERE group_id IS NOT NULL), b AS (SELECT group_id, arg_min(trim(title), (-length(trim(title)), trim(title))) FILTER (WHERE length(trim(title)) >= 4) AS t FROM short GROUP BY 1)
SELECT group_id, CASE WHEN t IS NULL THEN coalesce(CASE WHEN group_id NOT LIKE '%13' THEN k END, 'Untitled') WHEN length(t) > 50 THEN substr(t, 1, 45) || '…' ELSE t END AS title FROM b LEFT JOIN top USING (group_id)""")
def _(t):
    short = F.when(F.col("group_id").like("%3") | F.col("group_id").like("%5"), F.substring("title", 1, 3)).otherwise(F.col("title"))
    keywords = D.group_keywords(tagged(t)).filter("group_id not like '%13'")
    return E.group_titles(t.articles.withColumn("title", short), keywords)


# Scores and series

DECAY_SQL = "CASE category WHEN 'breaking' THEN 0.10 WHEN 'politics' THEN 0.04 WHEN 'it' THEN 0.02 ELSE 0.05 END"
AGE = f"(epoch({NOW}) - epoch(publish_time))"


@add("F1_freshness", f"SELECT article_id, round(100 * exp(-{DECAY_SQL} * greatest(0, {AGE} / 60)), 6) AS freshness FROM articles")
def _(t):
    return t.articles.select("article_id", F.round(S.freshness(F.col("publish_time"), F.col("category"), AS_OF), 6).alias("freshness"))


def share(x: str, full: int) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0 ELSE least(1.0, log2({x} + 1) / log2({full + 1})) END"


FEW_SQL = "CASE n WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 WHEN 3 THEN 0.7 WHEN 4 THEN 0.85 ELSE 1.0 END::DOUBLE"
GROUPED = f"ga AS (SELECT group_id, count(*) AS n, count(DISTINCT source) AS sources, max(publish_time) AS newest, min(publish_time) AS first_at, count(*) FILTER (WHERE {AGE} < 900) AS c15, count(*) FILTER (WHERE {AGE} < 3600) AS c1h, count(*) FILTER (WHERE {AGE} < 86400) AS c24 FROM articles WHERE group_id IS NOT NULL GROUP BY 1)"


@add("F2_trend_score", f"""WITH {GROUPED}, s AS (SELECT id, 100 * exp(-{DECAY_SQL} * greatest(0, (epoch({NOW}) - epoch(newest)) / 60)) AS fresh, n, sources, burst_score, early_trend_score FROM groups JOIN ga ON group_id = id),
p AS (SELECT *, round(least(fresh, 100) / 100 * 15 + {share('sources', 5)} * 15 + {share('n', 10)} * 30 + least(1, early_trend_score) * 10 + least(1, burst_score) * 15 + 0.2 * 15 + 1e-9, 2) AS pts FROM s)
SELECT id, round(fresh, 6) AS freshness, round(pts * {FEW_SQL} + 1e-9, 2) AS score, round(fresh + 1 + CASE WHEN n <= 1 THEN 0 ELSE least(20, 5 * log2(n)) END + early_trend_score, 6) AS raw_total FROM p""")
def _(t):
    n = t.articles.filter("group_id is not null").groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("article_count"), F.countDistinct("source").alias("source_count"), F.max("publish_time").alias("published_at"))
    rows = t.groups.join(n, "id").withColumns({"source_type": F.lit("default"), "social_signal": F.lit(0.0), "keyword_importance": F.col("early_trend_score"), "velocity": F.lit(0.2)})
    return S.trend_score(rows.drop("score"), AS_OF).select("id", r6("freshness"), "score", r6("raw_total"))


VELOCITY = "least(1.0, c1h / greatest(c24 / 24.0, 0.1) / 5)"


@add("F3_momentum", f"WITH {GROUPED} SELECT group_id, round(CAST({VELOCITY} AS DOUBLE), 6) AS velocity FROM ga")
def _(t):
    return S.momentum(t.articles, AS_OF).select("group_id", r6("velocity"))


@add("F4_momentum_15m", f"WITH {GROUPED} SELECT group_id, round(CAST(least(1.0, (2.0 * c15 + (c1h - c15)) / greatest(c24 / 24.0, 0.1) / 5) AS DOUBLE), 6) AS velocity FROM ga")
def _(t):
    n = t.articles.filter("group_id is not null").groupBy("group_id").agg(S.within(AS_OF, "publish_time", 900).alias("a"), S.within(AS_OF, "publish_time", 3600).alias("b"), S.within(AS_OF, "publish_time", 86400).alias("c"))
    return n.select("group_id", F.round(S.momentum_15m(F.col("a"), F.col("b"), F.col("c")), 6).alias("velocity"))


@add("F5_growth_type", f"WITH w AS (SELECT group_id, {', '.join(f'count(*) FILTER (WHERE floor({AGE} / 43200) = {i}) AS w{i}' for i in range(3))} FROM articles WHERE group_id IS NOT NULL GROUP BY 1) SELECT group_id, CASE WHEN w1 <= 2 AND w0 >= 3 * greatest(w1, 1) THEN 'spike' WHEN w0 >= w1 * 1.2 AND w1 >= w2 * 1.1 THEN 'growth' ELSE 'unknown' END AS growth_type FROM w")
def _(t):
    return S.growth_windows(t.articles, AS_OF).select("group_id", S.growth_type(F.col("w0"), F.col("w1"), F.col("w2")).alias("growth_type"))


HOURS = "hs AS (SELECT key, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM series GROUP BY 1, 2)"


def hourly(t: Tables) -> DataFrame:
    return R.hourly_series(t.series)


@add("F6_hourly_series", f"WITH {HOURS} SELECT key, {dstamp('ts')}, value FROM hs")
def _(t):
    return hourly(t).select("key", stamp("ts"), "value")


PARTS = f"""{HOURS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY key) AS n FROM hs),
l AS (SELECT key, max(n) AS n, max(value) FILTER (WHERE back = 1) AS last, avg(value) FILTER (WHERE back > 1) AS m, stddev_pop(value) FILTER (WHERE back > 1) AS s, avg(value) AS mu, stddev_pop(value) AS sd FROM o GROUP BY 1),
z AS (SELECT key, CASE WHEN n < 3 THEN 0 WHEN s = 0 THEN CASE WHEN last > m THEN 1 ELSE 0 END ELSE greatest(0, least(1, (last - m) / s / 6 + 0.5)) END::DOUBLE AS z_part FROM l),
p AS (SELECT key, CASE WHEN max(l.n) < 3 THEN 0 ELSE greatest(0, least(1, (CAST(count(*) FILTER (WHERE value <= last) AS DOUBLE) / count(*) - 0.5) * 2)) END::DOUBLE AS percentile_part FROM o JOIN l USING (key) GROUP BY 1),
cs AS (SELECT key, i, sum(value - 1.5 * mu) OVER (PARTITION BY key ORDER BY i) AS c FROM o JOIN l USING (key)), cm AS (SELECT key, c - least(0, min(c) OVER (PARTITION BY key ORDER BY i)) AS run FROM cs),
c AS (SELECT key, CASE WHEN max(n) < 3 THEN 0 ELSE greatest(0, least(1, greatest(0, max(run)) / max(CASE WHEN sd > 0 THEN 5 * sd ELSE mu + 1 END))) END::DOUBLE AS cusum_part FROM cm JOIN l USING (key) GROUP BY 1)"""


@add("F7_zscore_anomaly", f"WITH {PARTS} SELECT key, round(z_part, 6) AS z_part FROM z")
def _(t):
    return R.zscore_anomaly(hourly(t)).select("key", r6("z_part"))


@add("F8_percentile_anomaly", f"WITH {PARTS} SELECT key, round(percentile_part, 6) AS percentile_part FROM p")
def _(t):
    return R.percentile_anomaly(hourly(t)).select("key", r6("percentile_part"))


@add("F9_cusum", f"WITH {PARTS} SELECT key, round(cusum_part, 6) AS cusum_part FROM c")
def _(t):
    return R.cusum(hourly(t)).select("key", r6("cusum_part"))


@add("F10_detect_burst", f"WITH {PARTS}, b AS (SELECT key, round(0.4 * z_part + 0.35 * percentile_part + 0.25 * cusum_part, 9) AS x FROM z JOIN p USING (key) JOIN c USING (key)) SELECT key, round(x, 6) AS burst_score, CASE WHEN x > 0.90 THEN 'mega' WHEN x > 0.75 THEN 'high' WHEN x > 0.60 THEN 'normal' WHEN x >= 0.30 THEN 'low' ELSE 'end' END AS level FROM b")
def _(t):
    return R.detect_burst(hourly(t)).select("key", r6("burst_score"), "level")


@add("F11_early_score", f"WITH {GROUPED}, s AS (SELECT group_id, n, sources, round(0.4 * {VELOCITY} + 0.3 * sources / n + 0.3 * (1 - least(48, greatest(0, (epoch({NOW}) - epoch(newest)) / 3600)) / 48) + 1e-9, 4) AS x FROM ga) SELECT group_id, CASE WHEN sources < 2 THEN 0 WHEN n < 3 THEN least(x, 0.3) ELSE x END::DOUBLE AS early_trend_score FROM s")
def _(t):
    return S.early_score(t.articles, AS_OF)


BOOST = f"bp AS (SELECT DISTINCT platform, locale, lower(keyword) AS k FROM sns WHERE platform IN ('google_trends', 'naver') AND snapshot_at >= {NOW} - INTERVAL 24 HOURS), bw AS (SELECT DISTINCT id, locale, lower(unnest(keywords)) AS k FROM groups), bn AS (SELECT id, count(DISTINCT platform) AS platforms FROM bw JOIN bp USING (k, locale) GROUP BY 1), boosts AS (SELECT g.id, coalesce(platforms, 0) AS platforms, CASE WHEN platforms >= 2 THEN 1.3 WHEN platforms = 1 THEN 1.1 ELSE 1.0 END::DOUBLE AS boost FROM groups g LEFT JOIN bn ON bn.id = g.id)"


@add("F12_refresh_early", f"""WITH {GROUPED}, {BOOST}, s AS (SELECT g.id, n, sources, boost, round(greatest(0, least(1, 0.3 * least(1, burst_score) + 0.3 * least(1.0, (2.0 * c15 + (c1h - c15)) / greatest(c24 / 24.0, 0.1) / 5) + 0.2 * sources / n + 0.2 * greatest(0, 1 - (epoch({NOW}) - epoch(newest)) / 3600 / 48))) + 1e-9, 4) AS x
FROM groups g JOIN ga ON ga.group_id = g.id JOIN boosts b ON b.id = g.id WHERE g.created_at > {NOW} - INTERVAL 48 HOURS) SELECT id, round(least(1.0, boost * CASE WHEN sources < 2 THEN 0 WHEN n < 3 THEN least(x, 0.3) ELSE x END) + 1e-9, 4) AS early_trend_score FROM s""")
def _(t):
    return S.refresh_early(t.groups, t.articles, t.sns, AS_OF)


MULTIPLIER = "CASE WHEN sources >= 5 THEN 1.5 WHEN sources = 4 THEN 1.3 WHEN sources = 3 THEN 1.2 WHEN sources = 2 THEN 1.1 ELSE 1.0 END::DOUBLE"


@add("F13_source_multiplier", f"WITH {GROUPED} SELECT group_id, {MULTIPLIER} AS multiplier FROM ga")
def _(t):
    return t.articles.filter("group_id is not null").groupBy("group_id").agg(S.source_multiplier(F.countDistinct("source")).alias("multiplier"))


@add("F14_external_boost", f"WITH {BOOST} SELECT id, platforms, boost FROM boosts")
def _(t):
    return S.external_boost(t.groups, t.sns, AS_OF)


@add("F15_score_groups", f"""WITH {GROUPED}, fa AS (SELECT group_id, category, locale, publish_time AS first_time FROM articles WHERE group_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY publish_time, article_id) = 1),
series_ AS (SELECT group_id AS key, date_trunc('hour', publish_time) AS ts, CAST(count(*) AS DOUBLE) AS value FROM articles WHERE group_id IS NOT NULL GROUP BY 1, 2), {PARTS.replace(HOURS + ', ', '').replace('FROM hs', 'FROM series_')},
bu AS (SELECT z.key AS group_id, CASE WHEN l.n >= 5 THEN round(0.4 * z_part + 0.35 * percentile_part + 0.25 * cusum_part, 9) ELSE 0 END AS burst FROM z JOIN p USING (key) JOIN c USING (key) JOIN l USING (key)),
bp AS (SELECT DISTINCT platform, locale, lower(keyword) AS k FROM sns WHERE platform IN ('google_trends', 'naver') AND snapshot_at >= {NOW} - INTERVAL 24 HOURS), kws AS (SELECT DISTINCT group_id, 'k' || CAST(article_id % 13 AS VARCHAR) AS k FROM articles WHERE group_id IS NOT NULL),
eb AS (SELECT group_id, CASE WHEN count(DISTINCT platform) >= 2 THEN 1.3 ELSE 1.1 END::DOUBLE AS boost FROM kws JOIN fa USING (group_id) JOIN bp USING (k, locale) GROUP BY 1),
s AS (SELECT ga.group_id, n, sources, boost, round(least(100 * exp(-{DECAY_SQL} * greatest(0, (epoch({NOW}) - epoch(first_time)) / 60)), 100) / 100 * 15 + {share('sources', 5)} * 15 + {share('n', 10)} * 30 + 0.5 * 10 + least(1, burst) * 15 + {VELOCITY} * 15 + 1e-9, 2) AS pts, burst FROM ga JOIN fa USING (group_id) JOIN bu USING (group_id) LEFT JOIN eb USING (group_id))
SELECT group_id, n AS article_count, sources AS source_count, round(burst, 6) AS burst_score, round(least(100, round(pts * {FEW_SQL} + 1e-9, 2) * {MULTIPLIER} * coalesce(boost, 1.0)) + 1e-9, 2) AS score FROM s""")
def _(t):
    a = t.articles.withColumns({"keywords": F.array(F.concat(F.lit("k"), F.col("article_id") % 13)), "keyword_importance": F.lit(0.5)})
    return S.score_groups(a, t.sns, AS_OF).select("group_id", "article_count", F.col("source_count").cast("long").alias("source_count"), r6("burst_score"), "score")


@add("F16_trend_status", f"""WITH s AS (SELECT group_id, snapshot_at, CAST(sum(frequency) AS DOUBLE) / 10 AS score FROM snapshots GROUP BY 1, 2), l AS (SELECT *, lag(score) OVER (PARTITION BY group_id ORDER BY snapshot_at) AS prev, CASE CAST(round(score * 10) AS BIGINT) % 3 WHEN 0 THEN 'rising' WHEN 1 THEN 'down' ELSE 'steady' END AS d FROM s), c AS (SELECT *, CASE WHEN prev > 0 THEN (score - prev) / prev ELSE 0 END AS ch FROM l)
SELECT group_id, {dstamp('snapshot_at')}, CASE WHEN ch > 0.5 OR (score > 80 AND d = 'rising') THEN 'exploding' WHEN ch > 0.1 OR d = 'rising' THEN 'rising' WHEN ch > -0.1 AND score > 60 AND (d = 'down' OR ch < 0) THEN 'peaked' WHEN ch < -0.1 OR d = 'down' THEN 'declining' ELSE 'stable' END AS status FROM c""")
def _(t):
    from pyspark.sql import Window

    s = t.snapshots.groupBy("group_id", "snapshot_at").agg((F.sum("frequency").cast("double") / 10).alias("score"))
    s = s.withColumns({"prev": F.lag("score").over(Window.partitionBy("group_id").orderBy("snapshot_at")), "d": F.element_at(F.array(F.lit("rising"), F.lit("down"), F.lit("steady")), (F.round(F.col("score") * 10).cast("long") % 3 + 1).cast("int"))})
    return s.select("group_id", stamp("snapshot_at"), S.trend_status(F.col("score"), F.col("prev"), F.col("d")).alias("status"))


SEASON = "hh AS (SELECT *, weekofyear(ts) AS week, row_number() OVER (PARTITION BY keyword ORDER BY ts DESC, event_id DESC) AS r FROM history), hl AS (SELECT keyword, week AS now_week, value AS last FROM hh WHERE r = 1), hsn AS (SELECT hl.keyword, last, count(value) FILTER (WHERE week = now_week AND r > 1) AS past, avg(value) FILTER (WHERE week = now_week AND r > 1) AS m, stddev_pop(value) FILTER (WHERE week = now_week AND r > 1) AS s FROM hl JOIN hh USING (keyword) GROUP BY 1, 2), season AS (SELECT keyword, past, past >= 2 AND coalesce(last >= m - s - 1e-9 AND last <= m + s + 1e-9, false) AS seasonal FROM hsn)"


@add("F17_seasonality", f"WITH {SEASON} SELECT keyword, past, seasonal FROM season")
def _(t):
    return R.seasonality(t.history).select("keyword", "past", "seasonal")


@add("F18_burst_candidates", f"""WITH {SEASON}, cand AS (SELECT id, locale, early_trend_score, list_filter(keywords[1:3], lambda k: length(k) >= 2 AND NOT regexp_full_match(k, '[0-9]+')) AS kw FROM groups WHERE early_trend_score >= 0.75 AND created_at > {NOW} - INTERVAL 48 HOURS AND id NOT IN (SELECT group_id FROM jobs WHERE status IN ('running', 'success') AND triggered_at > {NOW} - INTERVAL 2 HOURS) ORDER BY early_trend_score DESC, id LIMIT 3)
SELECT id, locale, early_trend_score, array_to_string(kw, '|') AS keywords, EXISTS (SELECT 1 FROM season WHERE seasonal AND list_contains(kw, keyword)) AS is_seasonal FROM cand WHERE len(kw) > 0""")
def _(t):
    return S.burst_candidates(t.groups, t.jobs, R.seasonality(t.history), AS_OF).withColumn("keywords", F.array_join("keywords", "|")).select("id", "locale", "early_trend_score", "keywords", "is_seasonal")


DAILY = "dc AS (SELECT event_type AS key, CAST(ts AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2), dd AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY ds) - 1 AS DOUBLE) AS x FROM dc), li AS (SELECT key, count(*) AS n, CASE WHEN abs(count(*) * sum(x * x) - sum(x) * sum(x)) < 1e-10 THEN 0 ELSE regr_slope(y, x) END AS m, arg_max(y, x) AS last, max(ds) AS last_ds, avg(x) AS mx, avg(y) AS my, sum(x * x) AS sxx FROM dd GROUP BY 1), ln_ AS (SELECT *, my - m * mx AS b FROM li)"


def daily(t: Tables) -> DataFrame:
    rows = t.series.select(F.col("key").alias("group_id"), F.col("ts").alias("created_at"))
    return R.daily_counts(rows, "2100-01-01 00:00:00", 40000)


@add("F19_predict", f"WITH {DAILY}, p AS (SELECT *, round(CASE WHEN n < 3 THEN last ELSE greatest(0, m * n + b, m * (n + 2) + b) END, 9) AS peak FROM ln_) SELECT key AS group_id, round(peak, 6) AS predicted_peak, CASE WHEN n < 3 THEN 0.0 ELSE 0.3 END::DOUBLE AS confidence, CASE WHEN n < 3 THEN 'stable' WHEN last <= 0 THEN CASE WHEN peak > 0 THEN 'rising' ELSE 'stable' END WHEN peak / last > 1.1 THEN 'rising' WHEN peak / last < 0.9 THEN 'declining' ELSE 'stable' END AS direction FROM p")
def _(t):
    return R.predict(daily(t)).select("group_id", r6("predicted_peak"), "confidence", "direction")


@add("F20_forecast", f"""WITH {DAILY}, se AS (SELECT key, sqrt(round(sum((y - m * x - b) * (y - m * x - b)), 9) / count(*)) AS se FROM dd JOIN ln_ USING (key) GROUP BY 1), f AS (SELECT key, last_ds, i, m * (n + i) + b AS raw, 1.96 * se * sqrt(1 + 1.0 / n + pow(n + i - mx, 2) / sxx) AS mg FROM ln_ JOIN se USING (key), (SELECT unnest(range(30)) AS i) WHERE n >= 3)
SELECT key AS group_id, strftime(last_ds + CAST(i + 1 AS INTEGER), '%Y-%m-%d') AS ds, round(greatest(0, raw) + 1e-9, 2) AS yhat, round(greatest(0, greatest(0, raw) - mg) + 1e-9, 2) AS yhat_lower, round(greatest(0, greatest(0, raw) + mg) + 1e-9, 2) AS yhat_upper FROM f""")
def _(t):
    return R.forecast(daily(t), 30).withColumn("ds", F.date_format("ds", "yyyy-MM-dd"))


@add("F21_rescale_scores", "WITH g AS (SELECT id, score * 2 AS score FROM groups), t AS (SELECT max(score) AS top FROM g) SELECT id, CASE WHEN top > 100 THEN round(score / top * 100 + 1e-9, 2) ELSE score END AS score FROM g, t")
def _(t):
    return S.rescale_scores(t.groups.withColumn("score", F.col("score") * 2)).select("id", "score")


@add("F22_correct_scores", "WITH n AS (SELECT group_id AS id, count(*) AS n, count(DISTINCT source) AS s FROM articles WHERE group_id IS NOT NULL GROUP BY 1) SELECT id, round(score * CASE n WHEN 2 THEN 0.5 WHEN 3 THEN 0.7 WHEN 4 THEN 0.85 ELSE 1 END::DOUBLE + 1e-9, 2) AS score, CASE WHEN s <= 1 THEN 0 ELSE early_trend_score END AS early_trend_score FROM groups LEFT JOIN n USING (id)")
def _(t):
    return S.correct_scores(t.groups, t.articles).select("id", "score", "early_trend_score")


@add("F23_ranking_features", f"""WITH {GROUPED}, m AS (SELECT g.*, n, sources, (epoch({NOW}) - epoch(created_at)) / 60 AS minutes FROM groups g JOIN ga ON ga.group_id = g.id)
SELECT id, round(100 * exp(-{DECAY_SQL} * greatest(0, minutes)), 6) AS freshness_exp, CAST(hour(created_at) AS DOUBLE) AS hour_of_day, CASE WHEN minutes < 60 THEN 0 WHEN minutes < 360 THEN 1 WHEN minutes < 1440 THEN 2 WHEN minutes < 10080 THEN 3 ELSE 4 END::DOUBLE AS age_bucket, 10.0::DOUBLE AS source_reliability, CAST(n AS DOUBLE) AS group_count, round(burst_score / 1000, 6) AS dwell_time, least(score * 1000, 50000.0)::DOUBLE AS body_length, round(sources / CAST(n AS DOUBLE), 6) AS diversity_bonus FROM m""")
def _(t):
    n = t.articles.filter("group_id is not null").groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("article_count"), F.collect_list("source").alias("sources"))
    rows = t.groups.join(n, "id").withColumns({"published_at": F.col("created_at"), "source_type": F.lit("news"), "dwell_ms": F.col("burst_score"), "body_length": F.col("score") * 1000})
    return S.ranking_features(rows, AS_OF).select("id", r6("freshness_exp"), "hour_of_day", "age_bucket", "source_reliability", "group_count", r6("dwell_time"), "body_length", r6("diversity_bonus"))


@add("F24_ranking_training_set", f"WITH n AS (SELECT item_id AS id, count(*) FILTER (WHERE action = 'click') AS clicks, count(*) FILTER (WHERE action IN ('click', 'page_view')) AS impressions, coalesce(avg(dwell_ms) FILTER (WHERE dwell_ms > 0), 0) AS avg_dwell FROM actions WHERE created_at > {NOW} - INTERVAL 30 DAYS GROUP BY 1) SELECT id, clicks, impressions, round(avg_dwell, 4) AS avg_dwell, round(2.0 * clicks / greatest(impressions, 1) + 0.5 * least(avg_dwell / 30000, 1.0), 6) AS relevance FROM n JOIN groups USING (id) WHERE impressions >= 5")
def _(t):
    return S.ranking_training_set(t.actions, t.groups, AS_OF).select("id", "clicks", "impressions", F.round("avg_dwell", 4).alias("avg_dwell"), r6("relevance"))


# Feeds

FEED = f"fc AS (SELECT group_id, count(*) AS article_count, count(*) FILTER (WHERE {AGE} <= 10800) AS recent, count(*) FILTER (WHERE {AGE} > 10800 AND {AGE} <= 21600) AS previous FROM articles WHERE group_id IS NOT NULL GROUP BY 1)"
DIRECTION = "CASE WHEN recent > previous AND recent >= 2 THEN 'rising' WHEN recent < previous AND previous >= 2 THEN 'declining' ELSE 'steady' END"


@add("G1_direction", f"WITH {FEED} SELECT group_id, recent, previous, {DIRECTION} AS direction FROM fc")
def _(t):
    return G.direction(t.articles, AS_OF)


VISIBLE = f"{FEED}, vis AS (SELECT g.*, article_count, {DIRECTION} AS direction FROM groups g JOIN fc ON group_id = id WHERE article_count >= 2 AND NOT is_hidden)"


@add("G2_trend_feed", f"WITH {VISIBLE} SELECT id, category, title, score, article_count, direction FROM vis WHERE score >= 5.0 ORDER BY score DESC, id LIMIT 20")
def _(t):
    return G.trend_feed(t.groups, t.articles, AS_OF).select("id", "category", "title", "score", "article_count", "direction")


@add("G3_keyset_page", f"WITH {VISIBLE} SELECT id, score FROM vis WHERE score >= 5.0 AND (score < 60 OR (score = 60 AND id > 'g5')) ORDER BY score DESC, id LIMIT 15")
def _(t):
    return G.keyset_page(G.trend_feed(t.groups, t.articles, AS_OF, limit=None), (60.0, "g5"), 15).select("id", "score")


@add("G4_early_feed", f"WITH {VISIBLE} SELECT id, early_trend_score, article_count, direction FROM vis WHERE early_trend_score > 0.4 ORDER BY early_trend_score DESC, id LIMIT 20")
def _(t):
    return G.early_feed(t.groups, t.articles, AS_OF).select("id", "early_trend_score", "article_count", "direction")


@add("G5_related_trends", f"WITH {VISIBLE}, b AS (SELECT category, id AS related_id, score AS related_score, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS place FROM vis) SELECT g.id, related_id, related_score, CAST(row_number() OVER (PARTITION BY g.id ORDER BY place) AS INTEGER) AS rank FROM groups g JOIN b USING (category) WHERE g.id <> related_id QUALIFY row_number() OVER (PARTITION BY g.id ORDER BY place) <= 10")
def _(t):
    return G.related_trends(t.groups, t.articles, AS_OF)


@add("G6_trend_detail", "SELECT group_id, g.title AS group_title, score, CAST(row_number() OVER (PARTITION BY group_id ORDER BY publish_time DESC, article_id) AS INTEGER) AS rank, article_id, substr(body, 1, 200) AS snippet FROM articles a JOIN groups g ON g.id = a.group_id WHERE g.score >= 50 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY publish_time DESC, article_id) <= 50")
def _(t):
    return G.trend_detail(t.groups, t.articles, t.groups.filter("score >= 50").select("id")).select("group_id", "group_title", "score", "rank", "article_id", "snippet")


TIMELINE = f"tb AS (SELECT group_id, CAST(floor((86400 - {AGE}) / 3600) AS INTEGER) AS bucket, source FROM articles), tn AS (SELECT group_id, bucket, count(*) AS article_count, count(DISTINCT source) AS source_count FROM tb WHERE bucket BETWEEN 0 AND 24 GROUP BY 1, 2), spine AS (SELECT id AS group_id, title, CAST(b AS INTEGER) AS bucket FROM groups, (SELECT unnest(range(25)) AS b))"


@add("G7_timeline", f"WITH {TIMELINE} SELECT group_id, bucket, strftime({NOW} - INTERVAL 24 HOURS + to_hours(bucket), '%Y-%m-%d %H:%M:%S') AS bucket_start, coalesce(article_count, 0) AS article_count, coalesce(source_count, 0) AS source_count FROM spine LEFT JOIN tn USING (group_id, bucket)")
def _(t):
    return G.timeline(t.articles, t.groups.select("id"), "1h", AS_OF).select("group_id", "bucket", stamp("bucket_start"), F.col("article_count").cast("long").alias("article_count"), F.col("source_count").cast("long").alias("source_count"))


@add("G8_compare", f"WITH {TIMELINE} SELECT group_id, title, bucket, coalesce(article_count, 0) AS article_count FROM spine LEFT JOIN tn USING (group_id, bucket) WHERE group_id IN ('g0', 'g4', 'g5')")
def _(t):
    return G.compare(t.articles, t.groups, ["g0", "g4", "g5"], "1h", AS_OF).select("group_id", "title", "bucket", F.col("article_count").cast("long").alias("article_count"))


@add("G9_news_feed", f"SELECT article_id, {dstamp('publish_time')}, summary, coalesce(n, 1) AS article_count FROM (SELECT a.*, g.summary FROM articles a LEFT JOIN groups g ON g.id = a.group_id QUALIFY row_number() OVER (PARTITION BY coalesce(a.group_id, CAST(article_id AS VARCHAR)) ORDER BY publish_time DESC, article_id) = 1) x LEFT JOIN (SELECT group_id, count(*) AS n FROM articles WHERE group_id IS NOT NULL GROUP BY 1) c USING (group_id)")
def _(t):
    return G.news_feed(t.articles, t.groups, AS_OF, limit=None).select("article_id", stamp("publish_time"), "summary", "article_count")


SETS = [("a", ["the", "THING"]), ("b", ["que "]), ("c", ["zzzzqq"])]


@add("G10_search_articles", f"WITH q(query_id, k) AS (VALUES ('a', 'the'), ('a', 'thing'), ('b', 'que '), ('c', 'zzzzqq')), h AS (SELECT DISTINCT query_id, article_id, publish_time FROM articles JOIN q ON contains(lower(title), k)) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY publish_time DESC, article_id) AS INTEGER) AS rank, article_id FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY publish_time DESC, article_id) <= 10")
def _(t):
    return G.search_articles(t.articles, t.spark.createDataFrame(SETS, "query_id string, keywords array<string>")).select("query_id", "rank", "article_id")


FOUND = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY publish_time DESC, article_id) AS INTEGER) AS rank, article_id FROM h QUALIFY rank <= 10"


@add("G10_search_index", f"WITH q(query_id, k) AS (SELECT DISTINCT w, w FROM (SELECT regexp_extract(lower(title), '[a-z]{{5,}}') AS w FROM articles) WHERE w <> '' UNION ALL SELECT * FROM (VALUES ('A', 'the'), ('A', 'thing'), ('B', 'que '), ('C', 'zzzzqq'))), h AS (SELECT DISTINCT query_id, article_id, publish_time FROM articles JOIN q ON contains(lower(title), k)) {FOUND}")
def _(t):
    """Articles indexed in three batches, one of them twice; the first long word of every title is a query."""
    folder = stream_path(t)
    rows = t.articles.select(F.col("article_id").alias("id"), F.lower("title").alias("text"), "title", "publish_time")
    for b in (0, 1, 2, 1):
        N.index_batch(rows.filter(F.col("id") % 3 == b), folder, f"b{b}", 16)
    first = t.articles.select(F.regexp_extract(F.lower("title"), "[a-z]{5,}", 0).alias("w")).filter("w <> ''").distinct()
    sets = t.spark.createDataFrame([(q.upper(), w) for q, w in SETS], "query_id string, keywords array<string>")
    return G.search_index(t.spark, folder, first.select(F.col("w").alias("query_id"), F.array("w").alias("keywords")).unionByName(sets)).select("query_id", "rank", "article_id")


@add("G11_search_trends", "WITH q(query_id, k) AS (VALUES ('a', 'k1'), ('b', 'k7')), h AS (SELECT DISTINCT query_id, id, keyword, score FROM sns JOIN q ON contains(lower(keyword), k)) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, keyword FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def _(t):
    q = t.spark.createDataFrame([("a", ["K1"]), ("b", ["k7"])], "query_id string, keywords array<string>")
    return G.search_trends(t.sns, q).select("query_id", "rank", "id", "keyword")


@add("G12_dashboard", f"""WITH g AS (SELECT * FROM groups WHERE created_at > {NOW} - INTERVAL 24 HOURS), n AS (SELECT * FROM articles WHERE publish_time > {NOW} - INTERVAL 24 HOURS), c AS (SELECT category, count(*) AS n FROM g WHERE score >= 5 GROUP BY 1)
SELECT 'total' AS kind, 'total_trends' AS name, CAST(count(*) FILTER (WHERE score >= 5) AS DOUBLE) AS value FROM g UNION ALL SELECT 'total', 'avg_score', round(coalesce(avg(score) FILTER (WHERE score >= 5), 0) + 1e-9, 1) FROM g UNION ALL SELECT 'total', 'early_signal_count', count(*) FILTER (WHERE early_trend_score > 0.3) FROM g
UNION ALL SELECT 'total', 'total_news', count(*) FROM n UNION ALL SELECT 'category', category, n FROM c UNION ALL SELECT 'source', source, count(*) FROM n WHERE source IS NOT NULL GROUP BY source UNION ALL (SELECT 'top_category', category, n FROM c ORDER BY n DESC, category LIMIT 1)""")
def _(t):
    return G.dashboard(t.groups, t.articles, AS_OF)


@add("G13_regional", f"WITH g AS (SELECT * FROM groups WHERE created_at > {NOW} - INTERVAL 24 HOURS AND locale IS NOT NULL), c AS (SELECT locale, count(*) AS count FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), b AS (SELECT locale, id, row_number() OVER (PARTITION BY locale ORDER BY score DESC, id) AS r FROM g) SELECT locale, any_value(count) AS count, string_agg(id, '|' ORDER BY r) AS top_trends FROM c JOIN b USING (locale) WHERE r <= 3 GROUP BY 1")
def _(t):
    return G.regional(t.groups, AS_OF).withColumn("top_trends", F.array_join("top_trends", "|"))


@add("G14_pipeline_stats", f"SELECT a.*, trends_created, greatest(0, collected - clustered) AS spam_filtered FROM (SELECT count(*) AS collected, count(group_id) AS clustered FROM articles WHERE created_at >= TIMESTAMP '2024-01-30') a, (SELECT count(*) AS trends_created FROM groups WHERE created_at >= TIMESTAMP '2024-01-30') g")
def _(t):
    return G.pipeline_stats(t.articles, t.groups, "2024-01-30 00:00:00")


@add("G14_top_trends", "SELECT id, score, coalesce(n, 0) AS article_count FROM groups LEFT JOIN (SELECT group_id AS id, count(*) AS n FROM articles WHERE group_id IS NOT NULL GROUP BY 1) c USING (id) WHERE NOT is_hidden ORDER BY score DESC, id LIMIT 10")
def _(t):
    return G.top_trends(t.groups, t.articles).select("id", "score", F.col("article_count").cast("long").alias("article_count"))


HEALTH = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY feed_id ORDER BY ts DESC, event_id DESC) - 1 AS k FROM attempts),
ew AS (SELECT feed_id, i, latency_ms AS avg_ FROM o WHERE i = 1 UNION ALL SELECT o.feed_id, o.i, ew.avg_ * 0.7 + o.latency_ms * 0.3 FROM ew JOIN o ON o.feed_id = ew.feed_id AND o.i = ew.i + 1),
h AS (SELECT feed_id, max(ts) AS last_crawled_at, max(ts) FILTER (WHERE success) AS last_success_at, arg_min(error, k) FILTER (WHERE NOT success) AS last_error, coalesce(min(k) FILTER (WHERE success), count(*)) AS consecutive_failures, count(*) AS total_crawl_count, count(*) FILTER (WHERE NOT success) AS total_error_count FROM o GROUP BY 1)"""


@add("G15_feed_health", HEALTH + f" SELECT h.feed_id, {dstamp('last_crawled_at')}, {dstamp('last_success_at')}, last_error, consecutive_failures, total_crawl_count, total_error_count, round(avg_, 4) AS avg_latency_ms FROM h JOIN ew ON ew.feed_id = h.feed_id AND ew.i = total_crawl_count")
def _(t):
    h = G.feed_health(t.attempts)
    return h.select("feed_id", stamp("last_crawled_at"), stamp("last_success_at"), "last_error", "consecutive_failures", "total_crawl_count", "total_error_count", F.round("avg_latency_ms", 4).alias("avg_latency_ms"))


@add("G16_health_summary", HEALTH + """, st AS (SELECT CASE WHEN length(feed_id) % 2 = 0 THEN 'rss' ELSE 'community' END AS source_type, CASE WHEN last_crawled_at IS NULL THEN 'unknown' WHEN consecutive_failures >= 5 THEN 'error' WHEN consecutive_failures >= 2 OR epoch((SELECT max(ts) FROM attempts)) - epoch(last_success_at) > 1800 THEN 'degraded' ELSE 'healthy' END AS s FROM h)
SELECT source_type, count(*) AS total, count(*) FILTER (WHERE s = 'healthy') AS healthy, count(*) FILTER (WHERE s = 'degraded') AS degraded, count(*) FILTER (WHERE s = 'error') AS error, count(*) FILTER (WHERE s = 'unknown') AS unknown FROM st GROUP BY 1""")
def _(t):
    a = t.attempts
    h = G.feed_health(a).withColumn("source_type", F.when(F.length("feed_id") % 2 == 0, "rss").otherwise("community"))
    return G.health_summary(h.crossJoin(F.broadcast(a.agg(F.max("ts").alias("_now")))), F.col("_now"))


@add("G17_filtered_page", f"WITH f AS (SELECT id, user_id, action FROM audit WHERE action = 'login' AND created_at >= {NOW} - INTERVAL 100 DAYS AND created_at < {NOW}) SELECT id, user_id, action, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 20 OFFSET 20")
def _(t):
    rows = G.filtered_page(t.audit, {"action": "login"}, {"created_at": (A.ago(AS_OF, 100 * 86400), A.ts(AS_OF))}, {"action": "LOG"}, ["id"], 2, 20)
    return rows.select("id", "user_id", "action", "total")


@add("G18_account_rollups", """SELECT 'users' AS kind, 'total' AS name, count(*) AS value FROM users UNION ALL SELECT 'users', 'active', count(*) FROM users WHERE is_active UNION ALL SELECT 'users_by_plan', plan, count(*) FROM users GROUP BY plan UNION ALL SELECT 'subscriptions_by_plan', plan, count(*) FROM plans WHERE status = 'active' GROUP BY plan
UNION ALL SELECT 'usage', 'users', count(DISTINCT user_id) FROM events UNION ALL SELECT 'groups', 'total', count(*) FROM groups UNION ALL SELECT 'groups', 'today', count(*) FROM groups WHERE created_at >= TIMESTAMP '2024-01-30'""")
def _(t):
    return G.account_rollups(t.users, t.plans, t.events, t.groups, "2024-01-30 00:00:00")


# Behaviour, brands, alerts

BEHAVE = f"""ba AS (SELECT * FROM actions WHERE created_at > {NOW} - INTERVAL 30 DAYS), bc AS (SELECT user_id, 'category' AS kind, json_extract_string(meta, '$.category') AS name, count(*) AS cnt FROM ba WHERE action IN ('click', 'page_view', 'scrape') GROUP BY 1, 2, 3),
stats AS (SELECT * FROM bc WHERE name IS NOT NULL UNION ALL SELECT user_id, 'total', 'events', count(*) FROM ba GROUP BY 1 UNION ALL SELECT user_id, 'action', action, n FROM (SELECT user_id, action, count(*) AS n FROM ba GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, action) <= 10)"""


@add("H1_behavior_stats", f"WITH {BEHAVE} SELECT user_id, kind, name, CAST(cnt AS BIGINT) AS cnt FROM stats")
def _(t):
    return H.behavior_stats(t.actions, AS_OF)


SUGGEST = f"{BEHAVE}, sg AS (SELECT user_id, name AS category, round(0.5 + 1.5 * cnt / CAST(max(cnt) OVER (PARTITION BY user_id) AS DOUBLE) + 1e-9, 2) AS weight FROM stats WHERE kind = 'category')"


@add("H2_suggested_weights", f"WITH {SUGGEST} SELECT * FROM sg")
def _(t):
    return H.suggested_weights(H.behavior_stats(t.actions, AS_OF))


@add("H3_apply_weights", f"WITH {SUGGEST}, cur AS (SELECT c_custkey AS user_id, 'old' AS w, 0.25::DOUBLE AS r FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT user_id, string_agg(category || '=' || printf('%.2f', weight), '|' ORDER BY category) AS w FROM sg GROUP BY 1) SELECT coalesce(cur.user_id, n.user_id) AS user_id, coalesce(n.w, cur.w) AS weights, coalesce(r, 0.5) AS locale_ratio FROM cur FULL JOIN n ON n.user_id = cur.user_id")
def _(t):
    cur = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(None).cast("map<string,double>").alias("category_weights"), F.lit(0.25).alias("locale_ratio"))
    rows = H.apply_weights(cur, H.suggested_weights(H.behavior_stats(t.actions, AS_OF)))
    pairs = F.transform(F.map_entries("category_weights"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])))
    return rows.select("user_id", F.coalesce(F.array_join(F.array_sort(pairs), "|"), F.lit("old")).alias("weights"), "locale_ratio")


LABELS = f"count(*) FILTER (WHERE p > q) AS positive, count(*) FILTER (WHERE p = q) AS neutral, count(*) FILTER (WHERE q > p) AS negative, count(*) AS total"


@add("H4_sentiment_distribution", f"SELECT group_id, {LABELS} FROM (SELECT group_id, {SENTIMENT} FROM (SELECT group_id, lower(title || ' ' || substr(body, 1, 200)) AS x FROM articles WHERE group_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY publish_time DESC, article_id) <= 200)) GROUP BY 1")
def _(t):
    return H.sentiment_distribution(t.articles)


def aspect_groups(t: Tables) -> DataFrame:
    return t.groups.withColumn("keywords", F.array(F.lit("the"), F.lit("Good"), F.lit("que"), F.lit("ung")))


@add("H5_aspect_sentiment", f"""WITH a AS (SELECT group_id, title || chr(10) || body AS b, row_number() OVER (PARTITION BY group_id ORDER BY publish_time DESC, article_id) AS a FROM articles WHERE group_id IS NOT NULL), s AS (SELECT group_id, a, unnest(string_split_regex(b, '[.!?\\n]+')) AS s, generate_subscripts(string_split_regex(b, '[.!?\\n]+'), 1) AS i FROM a WHERE a <= 50),
c AS (SELECT group_id, a, i, substr(trim(s), 1, 512) AS s FROM s), h AS (SELECT c.*, k AS aspect, row_number() OVER (PARTITION BY group_id, k ORDER BY a, i) AS r FROM c JOIN groups g ON g.id = group_id, (VALUES ('the'), ('Good'), ('que'), ('ung')) v(k) WHERE s <> '' AND contains(lower(s), lower(k)))
SELECT group_id, aspect, {LABELS} FROM (SELECT group_id, aspect, {SENTIMENT} FROM (SELECT *, lower(s) AS x FROM h WHERE r <= 30)) GROUP BY 1, 2""")
def _(t):
    return H.aspect_sentiment(t.articles, aspect_groups(t))


BRAND = f"bk AS (SELECT DISTINCT id, unnest(keywords) AS keyword FROM brands), bs AS (SELECT bk.id, CASE sentiment_badge WHEN 'positive' THEN least(1, abs(burst_z) / 5) WHEN 'negative' THEN -least(1, abs(burst_z) / 5) ELSE 0 END AS v FROM bk JOIN sns s USING (keyword) WHERE snapshot_at >= {NOW} - INTERVAL 24 HOURS QUALIFY row_number() OVER (PARTITION BY bk.id ORDER BY snapshot_at DESC, s.id) <= 200), bb AS (SELECT b.id, coalesce(avg(v), 0) AS mean, coalesce(stddev_pop(v), 0) AS std FROM brands b LEFT JOIN bs ON bs.id = b.id GROUP BY 1)"


@add("H6_brand_baseline", f"WITH {BRAND} SELECT id, round(mean, 6) AS mean, round(std, 6) AS std FROM bb")
def _(t):
    return H.brand_baseline(t.brands, t.sns, AS_OF).select("id", r6("mean"), r6("std"))


@add("H7_brand_monitor", f"""WITH {BRAND}, mx AS (SELECT brand_id, {SENTIMENT}, greatest(len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')), 1) AS n FROM (SELECT brand_id, lower(text) AS x FROM mentions)), cu AS (SELECT brand_id, avg(CASE WHEN p > q THEN least(1.0, p / CAST(n AS DOUBLE)) WHEN q > p THEN -least(1.0, q / CAST(n AS DOUBLE)) ELSE 0 END) AS cur, count(*) AS mentions FROM mx GROUP BY 1),
z AS (SELECT id, coalesce(cur, 0) AS current, coalesce(mentions, 0) AS mentions, CASE WHEN std < 1e-12 THEN 0 ELSE (coalesce(cur, 0) - mean) / std END AS z FROM bb LEFT JOIN cu ON brand_id = id) SELECT id, round(current, 6) AS current, mentions, round(z, 6) AS z_score, CASE WHEN z < -2 THEN 'crisis' WHEN z > 2 THEN 'surge' ELSE 'normal' END AS label FROM z""")
def _(t):
    return H.brand_monitor(t.brands, t.mentions, t.sns, AS_OF).select("id", r6("current"), F.col("mentions").cast("long").alias("mentions"), r6("z_score"), "label")


@add("H8_brand_alerts", f"WITH {BRAND}, z AS (SELECT b.id, user_id, CASE WHEN std < 1e-12 THEN 0 ELSE -mean / std END AS z, mean, std FROM brands b JOIN bb ON bb.id = b.id WHERE is_active AND (last_alerted_at IS NULL OR last_alerted_at <= {NOW} - INTERVAL 24 HOURS)), l AS (SELECT *, CASE WHEN std < 1e-12 AND mean < -0.3 THEN 'crisis' WHEN z < -2 THEN 'crisis' WHEN z > 2 THEN 'surge' ELSE 'normal' END AS label FROM z) SELECT id, user_id, round(z, 6) AS z_score, label FROM l WHERE label <> 'normal'")
def _(t):
    return H.brand_alerts(t.brands, t.sns, AS_OF).select("id", "user_id", r6("z_score"), "label")


@add("H9_surge_alerts", "WITH w AS (SELECT DISTINCT id AS group_id, lower(unnest(keywords)) AS k FROM groups) SELECT DISTINCT user_id, group_id, k AS keyword FROM subs JOIN w ON lower(keyword) = k WHERE alert_surge")
def _(t):
    return H.surge_alerts(t.groups, t.subs)


@add("H10_daily_digest", f"""WITH best AS (SELECT * FROM posts WHERE snapshot_at >= {NOW} - INTERVAL 24 HOURS ORDER BY score DESC, id LIMIT 500), q AS (SELECT id, keyword AS title, score FROM best WHERE {QUESTION}),
h AS (SELECT k, id, title, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT DISTINCT lower(keyword) AS k FROM daily_subs WHERE alert_daily) w JOIN q ON contains(lower(title), k))
SELECT DISTINCT s.user_id, k AS keyword, rank, h.id FROM daily_subs s JOIN users u ON u.user_id = s.user_id AND email_enabled JOIN h ON h.k = lower(s.keyword) WHERE alert_daily AND rank <= 10""")
def _(t):
    return H.daily_digest(t.posts, t.daily_subs, t.users, AS_OF).select("user_id", "keyword", "rank", "id")


@add("H11_debounce_alerts", "SELECT service, event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY service ORDER BY ts, event_id)) >= 600, true) AS notify FROM alerts")
def _(t):
    return H.debounce_alerts(t.alerts).select("service", "event_id", "notify")


@add("H12_daily_usage", "WITH n AS (SELECT user_id, event_type AS endpoint, CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY 1, 2, 3) SELECT n.user_id, endpoint, strftime(day, '%Y-%m-%d') AS day, calls, coalesce(calls >= CASE u.plan WHEN 'free' THEN 2 WHEN 'pro' THEN 4 END, false) AS over FROM n LEFT JOIN users u ON u.user_id = n.user_id".replace("AS over", 'AS "over"'))
def _(t):
    limits = t.users.select("user_id", F.when(F.col("plan") == "free", 2).when(F.col("plan") == "pro", 4).alias("daily_limit"))
    rows = H.daily_usage(t.events.select("user_id", F.col("event_type").alias("endpoint"), F.col("ts").cast("timestamp").alias("ts")), limits)
    return rows.select("user_id", "endpoint", F.date_format("day", "yyyy-MM-dd").alias("day"), "calls", "over")


# Maintenance


ARCHIVED = f"SELECT id, created_at < {NOW} - INTERVAL 90 DAYS AS archived FROM audit"


@add("I1_archive_split", ARCHIVED)
def _(t):
    old, rest = H.archive_split(t.audit, AS_OF)
    return old.select("id", F.lit(True).alias("archived")).unionByName(rest.select("id", F.lit(False).alias("archived")))


@add("I1_archive_stored", ARCHIVED)
def _(t):
    live, archive = stream_path(t), stream_path(t)
    K.put_partitions(t.audit.withColumn("created_date", F.to_date("created_at")), live, "created_date")
    K.archive_stored(t.spark, live, archive, AS_OF)
    return t.spark.read.parquet(archive).select("id", F.lit(True).alias("archived")).unionByName(t.spark.read.parquet(live).select("id", F.lit(False).alias("archived")))


@add("I2_expire_plans", f"WITH f AS (SELECT user_id, max(CAST(status = 'active' AND expires_at < {NOW} AS INTEGER)) AS late, max(CAST(status = 'active' AND expires_at >= {NOW} AS INTEGER)) AS has FROM plans GROUP BY 1) SELECT u.user_id, CASE WHEN late = 1 AND has = 0 THEN 'free' ELSE plan END AS plan FROM users u LEFT JOIN f ON f.user_id = u.user_id")
def _(t):
    return H.expire_plans(t.plans, t.users, AS_OF)[1].select("user_id", "plan")


@add("I3_backfill_category", "SELECT article_id, CASE WHEN coalesce(a.category, 'general') = 'general' THEN coalesce(f.category, 'general') ELSE a.category END AS category FROM articles a LEFT JOIN feeds f ON f.name = a.source")
def _(t):
    return H.backfill_category(t.articles, t.feeds).select("article_id", "category")


# Streams, run over the table as a finite source and held against the batch definition


def streamed(t: Tables, name: str) -> DataFrame:
    return t.spark.readStream.schema(t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet").schema).option("pathGlobFilter", f"{name}*.parquet" if not t.sf_dir.startswith("viewfs") else "*.parquet").parquet(t.sf_dir)


def stream_path(t: Tables) -> str:
    import uuid

    from tidewatch.runtime import scratch_root

    return f"{scratch_root(t.spark)}/stream-{uuid.uuid4().hex}"


@add("J1_article_pipeline")
def _(t):
    from tidewatch.plans.pipeline import article_pipeline

    return article_pipeline(t.articles, AS_OF, t.sns).select("group_id", "article_count", "score", "growth_type")


@add("J1_article_stream")
def _(t):
    """The older half of the articles and then the newer, as files of two micro-batches, the second with the state of the
    first. The stream takes files by their time of writing, so the halves are written one after the other."""
    from tidewatch.plans.pipeline import INPUT
    from tidewatch.streaming import streams as J

    path, rows = stream_path(t), t.articles.select(*INPUT)
    middle = rows.agg(F.percentile(F.unix_seconds("publish_time"), F.lit(0.5)).alias("at")).first()["at"] or 0.0
    old = F.coalesce(F.unix_seconds("publish_time") < middle, F.lit(False))
    rows.filter(old).write.parquet(f"{path}/in", compression="zstd")
    files = max(1, len(t.spark.read.parquet(f"{path}/in").inputFiles()))
    rows.filter(~old).coalesce(files).write.mode("append").parquet(f"{path}/in", compression="zstd")
    J.start_pipeline(t.spark, f"{path}/in", f"{path}/out", f"{path}/state", rows.schema, lambda: AS_OF, files=files).awaitTermination()
    return J.newest_groups(t.spark.read.parquet(f"{path}/out")).select("group_id", "article_count", "score", "growth_type", "batch")


@add("J2_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    from tidewatch.streaming import streams as J

    rows = streamed(t, "events").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return J.stored(J.stream_dedupe(rows, "key", "ts").select("user_id", "event_type"), stream_path(t))


@add("J3_stream_hourly", f"WITH {HOURS} SELECT key, {dstamp('ts')}, value FROM hs WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM series) - INTERVAL 1 HOUR")
def _(t):
    from tidewatch.streaming import streams as J

    rows = streamed(t, "events").select(F.col("event_type").alias("key"), "ts")
    return J.stored(J.stream_hourly(rows), stream_path(t)).select("key", stamp("ts"), "value")


@add("J4_stream_trailing", f"WITH b AS (SELECT key, date_trunc('hour', ts) + to_minutes(CAST(15 * (floor(minute(ts) / 15) + o + 1) AS INTEGER)) AS e FROM series, (SELECT unnest([0, 1, 2, 3]) AS o)) SELECT key, strftime(e, '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS count FROM b WHERE e <= (SELECT max(ts) FROM series) - INTERVAL 1 HOUR GROUP BY 1, e")
def _(t):
    from tidewatch.streaming import streams as J

    rows = streamed(t, "events").select(F.col("event_type").alias("key"), "ts")
    return J.stored(J.stream_trailing(rows), stream_path(t)).select("key", stamp("ts"), "count")


@add("J4_stream_panes", f"""WITH p AS (SELECT key, date_trunc('hour', ts) + to_minutes(CAST(15 * floor(minute(ts) / 15) AS INTEGER)) AS s, count(*) AS n FROM series GROUP BY 1, 2), w AS (SELECT key, n, o, s + to_minutes(CAST(15 * (o + 1) AS INTEGER)) AS e FROM p, (SELECT unnest(range(96)) AS o))
SELECT key, {dstamp('e', 'ts')}, CAST(coalesce(sum(n) FILTER (WHERE o < 1), 0) AS BIGINT) AS c15, CAST(coalesce(sum(n) FILTER (WHERE o < 4), 0) AS BIGINT) AS c1h, CAST(sum(n) AS BIGINT) AS c24 FROM w WHERE e <= (SELECT max(ts) FROM series) - INTERVAL 1 HOUR GROUP BY key, e""")
def _(t):
    from tidewatch.streaming import streams as J

    rows = streamed(t, "events").select(F.col("event_type").alias("key"), "ts")
    return J.stored(J.stream_panes(rows), stream_path(t)).select("key", stamp("ts"), "c15", "c1h", "c24")


@add("J5_stream_debounce", "SELECT service, event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY service ORDER BY ts, event_id)) >= 600, true) AS notify FROM alerts")
def _(t):
    from tidewatch.streaming import streams as J

    rows = streamed(t, "events").filter("event_type = 'error'").select(F.concat(F.lit("s"), F.col("user_id") % 5).alias("service"), "event_id", "ts")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = J.stored(J.stream_debounce(rows), stream_path(t))
    finally:
        t.spark.conf.set(name, before)
    return out.select("service", "event_id", "notify")


@add("J6_stream_alerts", "SELECT DISTINCT s.user_id, 'g' || CAST(event_id AS VARCHAR) AS group_id, lower(s.keyword) AS keyword FROM events JOIN subs s ON lower(s.keyword) = 'k' || CAST(event_id % 1009 AS VARCHAR) WHERE alert_surge")
def _(t):
    from tidewatch.streaming import streams as J

    groups = streamed(t, "events").select(F.concat(F.lit("g"), F.col("event_id")).alias("id"), F.array(F.concat(F.lit("K"), F.col("event_id") % 1009)).alias("keywords"))
    return J.stored_alerts(groups, t.subs, stream_path(t))
