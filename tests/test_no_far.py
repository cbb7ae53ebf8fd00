"""Composite similarity where nothing is far: all pairs, each once, with no table of them between."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.adapters import Tables
from tidewatch.catalog import fast_r6
from tidewatch.operators import clusters as E
from tidewatch.operators import metric

SCHEMA = "item_id int, keywords array<string>, published_at timestamp, source_type string, embedding array<double>, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_items(spark, n, seed=3):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words = rnd.choice([None, [], [None], [f"a{i % 3}"], [f"a{i % 3}", f"b{i % 5}", None], [f"a{i % 3}", f"b{i % 5}", f"c{i % 7}", f"a{i % 3}"]])
        at = None if i % 9 == 4 else dt.datetime(2024, 1, 30) + dt.timedelta(hours=rnd.randrange(90))
        rows.append((i, words, at, rnd.choice([None, "", "x", "y"]), [rnd.gauss(0, 1) for _ in range(4)], "t" * (i % 40)))
    for i, odd in enumerate([[], [0.0] * 4, [float("nan")] + [1.0] * 3, [1.0, 2.0], [2.0, 1.0], [None, 1.0, 1.0, 1.0]]):
        rows[5 * i + 2] = (*rows[5 * i + 2][:4], odd, rows[5 * i + 2][5])
    return rows, spark.createDataFrame(rows, SCHEMA)


def weight(x, y):
    sound = lambda v: v and all(c is not None and math.isfinite(c) for c in v) and any(v)
    cosine = 0.0
    if sound(x[4]) and sound(y[4]) and len(x[4]) == len(y[4]):
        cosine = sum(a * b for a, b in zip(x[4], y[4])) / (math.hypot(*x[4]) * math.hypot(*y[4]))
    k, m = ({w for w in r[1] or [] if w is not None} for r in (x, y))
    near = 0.0 if x[2] is None or y[2] is None else math.exp(-abs((x[2] - y[2]).total_seconds()) / 86400)
    alike = 0.5 if not x[3] or not y[3] else float(x[3] == y[3])
    return 0.5 * cosine + 0.25 * (len(k & m) / len(k | m) if k | m else 0) + 0.15 * near + 0.1 * alike


@pytest.mark.parametrize("sizes", [((2, 7), 5, 2), ((64, 64), 10, 3), ((1, 4), 64, 16)])
def test_all_pairs_once_and_no_table_of_them(spark, monkeypatch, sizes):
    for name, value in zip(("CHUNKS", "TILE", "THIN"), sizes):
        monkeypatch.setattr(metric, name, value)
    monkeypatch.setattr(E, "WORD_PAIRS", 1)
    monkeypatch.setattr(E, "keyword_pairs", None)  # pairs of like keywords are as many as the square of a word's items
    rows, items = some_items(spark, 60)
    edges = E.similar_by_vectors(items, E.Similarity(threshold=0.25))
    assert "Aggregate" not in plan(edges)  # which would shuffle all pairs
    got = [(r.a, r.b, round(r.weight, 9)) for r in edges.collect()]
    pairs = {(x[0], y[0]): weight(x, y) for x, y in itertools.combinations(rows, 2)}
    want = {(a, b, round(w, 9)) for (a, b), w in pairs.items() if w >= 0.25}
    assert len(got) == len(set(got)) and set(got) == want and 100 < len(want) < len(pairs) * 0.9


def test_pairs_from_keywords_do_not_come_from_vectors_too(spark, monkeypatch):
    rows, items = some_items(spark, 60)
    items = items.filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    for few in (1, 10_000):
        monkeypatch.setattr(E, "WORD_PAIRS", few)
        edges = E.similar_by_vectors(items, E.Similarity(threshold=0.3))
        found = {(r.a, r.b): round(r.weight, 9) for r in edges.collect()}
        assert edges.count() == len(found)
        first = found if few == 1 else first
    assert found == first and len(found) > 100


def test_what_hangs_together_is_not_compared(spark, monkeypatch):
    for name, value in (("CHUNKS", (16, 16)), ("TILE", 6), ("THIN", 2)):
        monkeypatch.setattr(metric, name, value)
    _, items = some_items(spark, 90, 8)
    monkeypatch.setattr(E, "WORD_PAIRS", 1)
    for threshold in (0.3, 0.55, 0.7):
        p = E.Similarity(threshold=threshold)
        edges, forest = E.similarity_edges(items, p), E.similarity_edges(items, p, forest=True)
        clusters = [{(r.item_id, r.cluster_id) for r in E.topic_clusters(items, e).collect()} for e in (edges, forest)]
        assert clusters[0] == clusters[1]
    chunks = -(-90 // 16)
    assert E.similarity_edges(items, E.Similarity(threshold=0.2), forest=True).count() < 90 * chunks


def test_fast_rounding_is_rounding(spark):
    rnd = random.Random(1)
    values = [*(rnd.random() for _ in range(2000)), *(n / 1e6 + 5e-7 for n in range(500)), 0.0, -1e-9, -0.3333335, 1e300, -1e12, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "w double")
    assert df.select(fast_r6("w").alias("x"), F.round("w", 6).alias("y")).filter("not (x <=> y)").isEmpty()


def test_whole_texts_do_not_go_through_the_join(spark):
    vectors = Tables(spark, "/root/testdata/sf0.001").vectors
    below = plan(vectors).split("Join", 1)[1]
    assert "substring(text" in below and ", 1, 60)" in below
    want = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.text == want[r.article_id][: r.article_id % 60] for r in vectors.collect())
