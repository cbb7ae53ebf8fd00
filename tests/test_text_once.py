"""Spam rules read a text once; text jobs of the catalogue run in small Arrow batches."""

from pyspark.sql import functions as F

from tidewatch.functions import text as T

ODD = ["", " ", "  x ", "a \n", "\n\na b\n\n", " one\ttwo ", "HTTPS://A.B c", "http:// x", "hTTp://q", "GRATIS" * 3, "!!! ??? !!!", "0101234567 02-345-6789", "3월 4일 알림", "İ Casino LOTTERY prize", "x\u001c", None]


def test_spam_rules_make_the_text_once(spark):
    rows = spark.createDataFrame([(n, t, t) for n, t in enumerate(ODD)], "article_id int, title string, body string")
    plan = T.filter_spam(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") <= 1 and plan.count("Contains(") + plan.count("contains(") <= 40
    assert T.filter_spam(rows).columns == rows.columns


def test_spam_features_of_odd_texts(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(ODD)], "id int, text string")
    t = F.coalesce("text", F.lit(""))
    urls = F.regexp_extract_all(t, F.lit(f"({T.SPAM_URL})"), 1)
    whole = F.length(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    want = rows.select("id", whole.alias("content_length"), F.size(urls).alias("url_count"), T.occurrences(F.lower(t), T.SPAM_WORDS).alias("keyword_hits"))
    got = T.spam_features(rows)
    assert "_once" not in got.columns and "_once" not in T.classify_spam(rows).columns
    key = lambda df: sorted(map(tuple, df.select("id", "content_length", "url_count", "keyword_hits").collect()))
    assert key(got) == key(want) and len(key(got)) == len(ODD)


def test_articles_are_normalised_in_one_worker(spark):
    rows = spark.createDataFrame([(1, "[a] <b>T</b> &amp; U (3)", "x &lt;b&gt; <i>y</i>"), (2, "12 34", "z"), (3, None, "q"), (4, "é", None)], "article_id int, title string, body string")
    out = T.normalize_articles(rows)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert out.columns == rows.columns
    want = rows.select("article_id", T.normalize_title(F.col("title")).alias("title"), T.normalize_text(F.col("body")).alias("body")).collect()
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in want if r.title != "")


def test_tables_bound_arrow_batches_by_bytes(spark):
    from tidewatch.adapters import Tables

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    Tables(spark, "/nowhere")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("4m", "4194304b")
