"""Exact de-duplication against brute force, and the join that splits hot keys."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import dedup_exact
from tidewatch.llm.skew import fresh, spread_join


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("limit", [dedup_exact.BROADCAST, 0])
@pytest.mark.parametrize("all_digests", [True, False])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_exact_dedup(docs, texts, limit, all_digests, kind):
    groups, alike = collections.defaultdict(list), collections.Counter()
    for i, t in texts.items():
        groups[plain(t)].append(i)
        alike[len(plain(t)), plain(t)[:64]] += 1
    order = (lambda i: i) if kind == "long" else str
    rows = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    out = dedup_exact.exact_dedup(rows, all_digests=all_digests, broadcast_limit=limit).collect()
    assert len(out) == len(texts)
    for r in out:
        norm = plain(texts[int(r.doc_id)])
        keep = min(groups[norm], key=lambda i: (-len(texts[i] or ""), order(i)))
        digest = hashlib.sha256(norm.encode()).hexdigest() if all_digests or alike[len(norm), norm[:64]] > 1 else None
        assert (int(r.keep_id), r.group_size, r.kept, r.digest) == (keep, len(groups[norm]), keep == int(r.doc_id), digest)


def test_only_what_hits_the_filter_is_hashed(spark, monkeypatch):
    """Whatever is broadcast later: texts are hashed where the filter hits, before any shuffle of them."""
    seen = {}
    plain = dedup_exact.written
    monkeypatch.setattr(dedup_exact, "written", lambda df, label: seen.setdefault(label, plain(df, label)))
    rows = [(i, f"text {i % 5000} " + "x" * (i % 5000 % 300)) for i in range(5000)] + [(9000 + i, f"text {i}  " + "x" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dedup_exact.exact_dedup(df, broadcast_limit=0)
    assert out.filter("group_size > 1").count() == 80
    hashed = seen["dedup-short"].filter("full is not null").count()
    assert 80 <= hashed < 80 + 5000 / 8  # keys that survive, and few of the others
    assert hashed < seen["dedup-short"].count()


def test_a_full_filter_only_hashes_more(docs):
    want = sorted(map(tuple, dedup_exact.exact_dedup(docs).collect()), key=str)
    assert sorted(map(tuple, dedup_exact.exact_dedup(docs, filter_bytes=1, broadcast_limit=0).collect()), key=str) == want


@pytest.mark.parametrize("limit", [dedup_exact.BROADCAST, 0])
def test_odd_tables(docs, spark, limit):
    assert dedup_exact.exact_dedup(docs.limit(0), broadcast_limit=limit).count() == 0
    twice = docs.unionByName(docs).withColumn("kept", F.lit(1)).withColumn("Kept_", F.lit(2)).withColumn("key", F.lit(3))
    out = dedup_exact.drop_copies(twice, broadcast_limit=limit)
    assert out.columns == twice.columns and out.count() == 2 * dedup_exact.drop_copies(docs).count()
    long = "x" * 3_000_000
    rows = [(None, None), (None, "a b"), (3, "ab"), (4, None), (5, long), (6, long + " "), (7, "a c"), (7, "a c")]
    got = dedup_exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_limit=limit).collect()
    said = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert said == {(None, 4, 2, False): 1, (4, 4, 2, True): 1, (None, None, 2, True): 1, (3, None, 2, False): 1, (5, 6, 2, False): 1, (6, 6, 2, True): 1, (7, 7, 2, True): 2}


def test_spread_join(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 99, k) for k in range(300)] + [(None, -1)], "k int, v int")
    groups = rows.filter("k is not null and k <> 5").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, rows.join(groups, "k", "left").collect()), key=str)
    for limit, least in ((1 << 20, 1), (0, 1), (0, 50), (0, 1000)):
        got = spread_join(rows, groups, ["k"], "n", 300, 16, limit, hot=1000, least=least)
        assert got.columns == ["k", "v", "n"] and sorted(map(tuple, got.collect()), key=str) == want
    assert fresh("a", ["A", "a_"]) == "a__"
