"""Stored tables: touched partitions alone change, repeated writes change nothing; counts over batches are those of the union."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tidewatch.operators import keywords as D
from tidewatch.sources import stored as K

AT = dt.datetime(2024, 1, 30)
NOW = "2024-01-30 00:00:00"


def files(path):
    """Data files by partition folder."""
    return {d: sorted(f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}


def trends(spark, rows):
    return spark.createDataFrame([(i, "reddit", k, "en", AT + dt.timedelta(hours=h), 1.0) for i, k, h in rows], "id long, platform string, keyword string, locale string, snapshot_at timestamp, score double")


def test_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    K.upsert_stored(trends(spark, [(i, f"k{i}", 0) for i in range(40)]), path, 8)
    before = files(path)
    new = trends(spark, [(100, "k3", 1), (101, "k4", -1), (102, None, 0), (103, None, 0)])
    K.upsert_stored(new, path, 8)
    after = files(path)
    touched = {f"bucket={r.b}" for r in new.select(F.pmod(F.xxhash64("platform", "keyword", "locale"), F.lit(8)).alias("b")).distinct().collect()}
    assert {d for d in after if after[d] != before.get(d)} == touched < set(after)
    rows = lambda: sorted((r.id, r.keyword) for r in spark.read.parquet(path).collect())
    got = rows()
    assert (100, "k3") in got and (3, "k3") not in got and (4, "k4") in got and (103, None) in got and len(got) == 41
    K.upsert_stored(new, path, 8)
    K.upsert_stored(new.limit(0), path, 8)
    assert rows() == got


def test_assignment_rewrites_touched_days_alone(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [(i, f"u{i}", None if i == 9 else (AT + dt.timedelta(days=i % 3)).date(), "old") for i in range(10)]
    K.put_partitions(spark.createDataFrame(rows, "article_id long, url_hash string, publish_date date, group_id string"), path, "publish_date")
    before = files(path)
    new = spark.createDataFrame([("u1", "b"), ("u1", "a"), ("u4", "c"), ("zz", "d"), (None, "e")], "url_hash string, group_id string")
    assert K.touched_days(new, path) == [dt.date(2024, 1, 31)]
    K.assign_stored(new, path)
    after = files(path)
    assert [d for d in after if after[d] != before[d]] == ["publish_date=2024-01-31"]
    got = {r.article_id: r.group_id for r in spark.read.parquet(path).collect()}
    assert got == {i: {1: "a", 4: "c"}.get(i, "old") for i in range(10)}
    K.assign_stored(new.limit(0), path)
    assert files(path) == after


def test_archive_moves_whole_days_and_takes_late_rows(spark, tmp_path):
    live, archive = str(tmp_path / "live"), str(tmp_path / "archive")

    def audit(rows):
        return spark.createDataFrame([(i, None if d is None else AT - dt.timedelta(days=d)) for i, d in rows], "id long, created_at timestamp").withColumn("created_date", F.to_date("created_at"))

    K.put_partitions(audit([(1, 100), (2, 100), (3, 95.5), (4, 90), (5, 1), (6, None)]), live, "created_date")
    ids = lambda path: sorted(r.id for r in spark.read.parquet(path).collect())
    K.archive_stored(spark, live, archive, NOW)
    assert ids(archive) == [1, 2, 3] and ids(live) == [4, 5, 6]
    kept = files(live)
    K.archive_stored(spark, live, archive, NOW)
    assert ids(archive) == [1, 2, 3] and files(live) == kept
    K.put_partitions(audit([(7, 100), (2, 100)]), live, "created_date")  # one late row, one that stopped half way
    K.archive_stored(spark, live, archive, NOW)
    assert ids(archive) == [1, 2, 3, 7] and ids(live) == [4, 5, 6]


def test_running_counts_are_those_of_the_union(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "FOLD", 2)
    terms = spark.createDataFrame([(a, f"t{j}", 1 + (a + j) % 3) for a in range(14) for j in range(a % 5)], "article_id long, term string, tf long")
    path = str(tmp_path / "terms")
    for n in (0, 1, 2, 2, 3, 4, 4, 5, 6):
        df, stats = D.running_stats(terms.filter(F.col("article_id") % 7 == n), path, n)
    want, total = D.corpus_stats(terms)
    assert sorted(df.collect()) == sorted(want.collect())
    assert stats.collect() == total.collect()
    assert sorted(os.listdir(path)) == ["batch=6", "fold=5"]  # what was folded is gone


def test_running_counts_without_terms(spark, tmp_path):
    df, stats = D.running_stats(spark.createDataFrame([], "article_id long, term string, tf long"), str(tmp_path / "none"), 0)
    assert df.collect() == [] and [tuple(r) for r in stats.collect()] == [(0, None)]
