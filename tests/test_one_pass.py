"""Scores and dashboards from one pass: exchanges and scans in the plans, and what windows and grouping sets must keep."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import feeds as G
from tidewatch.operators import scoring as S
from tidewatch.operators import series as R

AT = dt.datetime(2024, 1, 30, 12)
NOW = "2024-01-30 12:00:00"


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text, len(re.findall(r"Exchange hashpartitioning", text))


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def series(spark, rows):
    return spark.createDataFrame([(k, AT + dt.timedelta(hours=i), v) for k, i, v in rows], "key string, ts timestamp, value double")


def test_burst_is_one_shuffle_and_collects_nothing(spark, tmp_path):
    df = R.detect_burst(stored(series(spark, [("a", i, float(i)) for i in range(9)]), tmp_path / "s"))
    text, shuffles = plan(df)
    assert shuffles == 1 and "collect_list" not in text and "Join" not in text
    assert df.count() == 1


def brute(values):
    """The three parts of a series by their definitions, point after point."""
    if len(values) < 3:
        return 0.0, 0.0, 0.0
    clamp = lambda x: max(0.0, min(1.0, x))
    last, past = values[-1], values[:-1]
    mean = lambda v: sum(v) / len(v)
    spread = lambda v: (sum((x - mean(v)) ** 2 for x in v) / len(v)) ** 0.5
    z = (1.0 if last > mean(past) else 0.0) if spread(past) == 0 else clamp((last - mean(past)) / spread(past) / 6 + 0.5)
    c = top = 0.0
    for x in values:
        c = max(0.0, c + x - 1.5 * mean(values))
        top = max(top, c)
    limit = 5 * spread(values) if spread(values) > 0 else mean(values) + 1
    return z, clamp((sum(x <= last for x in values) / len(values) - 0.5) * 2), clamp(top / limit)


def test_parts_equal_their_definitions(spark):
    import random

    draw = random.Random(5)
    want = {f"k{n}": [float(draw.choice((0, 1, 2, 3, 40))) for _ in range(draw.randint(1, 60))] for n in range(40)}
    rows = [(k, i, v) for k, vs in want.items() for i, v in enumerate(vs)]
    draw.shuffle(rows)
    got = R.anomalies(series(spark, rows)).collect()
    assert len(got) == 40
    for r in got:
        assert (r.z_part, r.percentile_part, r.cusum_part) == pytest.approx(brute(want[r.key]), abs=1e-9) and r.points == len(want[r.key])


def test_series_of_ties_nulls_and_nothing(spark):
    same = [("t", 0, 1.0), ("t", 0, 9.0), ("t", 0, 4.0), ("n", 0, None), ("n", 1, 2.0)]
    got = {r.key: r for r in R.anomalies(series(spark, same)).collect()}
    assert got["n"].points == 1 and got["n"].z_part == 0 and got["t"].points == 3 and got["t"].percentile_part == 1.0
    assert R.detect_burst(series(spark, [])).collect() == []


def articles(spark, rows):
    return spark.createDataFrame([(g, s, None if h is None else AT - dt.timedelta(hours=h), i) for i, (g, s, h) in enumerate(rows)], "group_id string, source string, publish_time timestamp, article_id long")


def test_group_figures_equal_the_single_counts(spark, tmp_path):
    rows = [("a", "x", 0.5), ("a", "x", 0.2), ("a", "y", 13), ("a", "", 30), ("a", None, 2), ("b", "x", None), (None, "x", 1), ("c", "z", -1), ("c", "y", 100)]
    a = stored(articles(spark, rows), tmp_path / "a")
    df = S.group_figures(a, NOW, first=("publish_time", "article_id"))
    assert plan(df)[1] == 2
    got = {r.group_id: r for r in df.collect()}
    assert {k: (r.n, r.sources) for k, r in got.items()} == {"a": (5, 2), "b": (1, 1), "c": (2, 2)}
    assert {r.group_id: r.velocity for r in S.momentum(a, NOW).collect()} == {k: r.velocity for k, r in got.items()}
    assert {r.group_id: (r.w0, r.w1, r.w2) for r in S.growth_windows(a, NOW).collect()} == {k: (r.w0, r.w1, r.w2) for k, r in got.items()}
    assert got["a"].f.article_id == 3 and got["b"].f.publish_time is None and got["b"].early_trend_score == 0
    assert got["a"].early_trend_score == pytest.approx(round(0.4 * got["a"].velocity + 0.3 * 2 / 5 + 0.3 * (1 - 0.2 / 48) + 1e-9, 4))


def groups(spark, rows):
    return spark.createDataFrame([(c, s, e, AT - dt.timedelta(hours=h)) for c, s, e, h in rows], "category string, score double, early_trend_score double, created_at timestamp")


def test_dashboard_scans_each_table_once(spark, tmp_path):
    g = stored(groups(spark, [("b", 9.0, 0.5, 1), ("a", 7.0, 0.1, 2), ("a", 1.0, 0.9, 2), ("b", 99.0, 0.9, 25), (None, 5.0, None, 3), ("z", 4.0, 0.0, 1)]), tmp_path / "g")
    a = stored(articles(spark, [("a", "x", 1), ("a", "x", 2), ("a", None, 2), ("a", "y", 30)]), tmp_path / "a")
    df = G.dashboard(g, a, NOW)
    assert plan(df)[0].count("FileScan") == 2
    got = {(r.kind, r.name): r.value for r in df.collect()}
    assert got == {("total", "total_trends"): 3, ("total", "avg_score"): 7.0, ("total", "early_signal_count"): 2, ("total", "total_news"): 3, ("category", "a"): 1, ("category", "b"): 1, ("category", None): 1, ("source", "x"): 2, ("top_category", None): 1}


def test_dashboard_of_an_empty_day(spark):
    got = G.dashboard(groups(spark, []), articles(spark, []), NOW).filter(F.col("value") == 0).collect()
    assert {r.name for r in got} == {"total_trends", "avg_score", "early_signal_count", "total_news"}
