"""Alerts of one keyword are dealt over keys; brands with equal keywords share a row; texts are counted in their row."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import behavior as H
from tidewatch.operators.keywords import bigrams
from tidewatch.streaming import streams as J


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_surge_alerts_of_one_keyword(spark):
    groups = spark.range(700).select(F.concat(F.lit("g"), "id").alias("id"), F.array(F.lit("Hot"), F.lit("hot")).alias("keywords"))
    subs = spark.range(30).select(F.col("id").alias("user_id"), F.lit("HOT").alias("keyword"), F.lit(True).alias("alert_surge"))
    got = H.surge_alerts(groups, subs)
    assert got.count() == got.distinct().count() == 700 * 30
    assert "part#" in plan(got)  # the join has more keys than the keyword


def test_brands_with_equal_keywords(spark):
    at = dt.datetime(2024, 1, 30, 12)
    brands = spark.createDataFrame([(i, f"b{i}", ["k", "l"] if i % 2 else ["l", "k", "k"]) for i in range(50)] + [(99, "x", []), (98, "none", None)], "id long, brand_name string, keywords array<string>")
    sns = spark.createDataFrame([(n, "k" if n < 3 else "x", 5.0, "positive" if n % 2 else "negative", at) for n in range(5)], "id long, keyword string, burst_z double, sentiment_badge string, snapshot_at timestamp")
    got = {r.id: (round(r["mean"], 6), round(r["std"], 6)) for r in H.brand_baseline(brands, sns, "2024-01-31 00:00:00").collect()}
    assert len(got) == 52 and len({got[i] for i in range(50)}) == 1 and got[0] == (-0.333333, 0.942809) and got[99] == (0.0, 1.0) and got[98] == (0.0, 0.0)


def test_bigrams_shuffle_nothing(spark):
    rows = spark.createDataFrame([(1, "red fox red fox red red hen"), (2, "one"), (3, None)], "article_id long, body string")
    got = bigrams(rows)
    assert "Exchange" not in plan(got)
    assert {(r.article_id, r.bigram, r.freq, round(r.score, 6)) for r in got.collect()} == {(1, "red_fox", 2, round(0.5 * (4 / 7 + 2 / 7) / 2, 6)), (1, "fox_red", 2, round(0.5 * (4 / 7 + 2 / 7) / 2, 6))}


def test_the_stream_of_alerts_stores_no_product(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "KEYWORD_PART", 16)
    monkeypatch.setattr(H, "LIST", 8)
    groups = spark.range(300).select(F.concat(F.lit("g"), "id").alias("id"), F.array(F.lit("Hot"), F.lit("hot"), F.when(F.col("id") % 3 == 0, "cold"), F.lit("other")).alias("keywords"))
    groups.write.parquet(str(tmp_path / "in"))
    subs = spark.createDataFrame([(i, ["HOT", "Cold", "none", None][i % 4], i % 5 != 0) for i in range(120)] + [(1, "cold", True), (None, "cold", True)], "user_id long, keyword string, alert_surge boolean")
    read = lambda: spark.readStream.schema(groups.schema).parquet(str(tmp_path / "in"))
    got = J.stored_alerts(read(), subs, str(tmp_path / "alerts"))
    want = H.surge_alerts(groups, subs)
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) == sorted(set(rows)) and len(rows) > 7000
    assert spark.read.parquet(str(tmp_path / "alerts/out")).count() == 300 + 100
    assert sorted(map(str, J.stored(J.stream_alerts(read(), subs), str(tmp_path / "plain")).collect())) == rows
