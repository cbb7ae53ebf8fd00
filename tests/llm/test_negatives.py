import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score double, row string"


def brute(rows, anchor, positives=5, k=10):
    valid = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in valid:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in valid if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:k]
            out += [(i, p, n, j, -s, -t) for n, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(rnd, n, d=6, spread=0.4, labels=4):
    centres = [[rnd.gauss(0, 1) for _ in range(d)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rnd.randrange(labels)
        length = rnd.choice([0.1, 1, 1, 3])
        rows.append((i, label, [length * (c + rnd.gauss(0, spread)) for c in centres[rnd.randrange(labels)]], 0.5, "x"))
    return rows


def mined(df, every=10):
    out = negatives.hard_negatives(df, F.col("vec_id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    rows = vectors(rnd, 300)
    rows += [(1000 + i, i % 4, rows[7][2], 0.1, "copy") for i in range(40)]  # equal vectors
    rows += [(2000, None, rows[3][2], 0.1, "-"), (2010, 1, None, 0.1, "-"), (2020, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0.1, "-"), (2030, 1, [float("nan")] * 6, 0.1, "-")]
    rows += [(2040, 1, [float("inf")] + [0.0] * 5, 0.1, "-"), (None, 1, rows[4][2], 0.1, "-"), (2050, 1, [0.0] * 6, 0.1, "zero"), (2060, 1, [1.0, 2.0], 0.1, "short"), (2061, 2, [1.0, 1.5], 0.1, "short"), (2062, 1, [1.0, 2.5], 0.1, "short"), (2070, 1, [], 0.1, "none")]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert mined(df) == want
    for name, value in (("BUCKET", 16), ("PIECE_ANCHORS", 11), ("PIECE_ROWS", 37), ("LEAST_ROWS", 20)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(df) == want


def test_empty_table_and_lone_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(0, 1, [1.0, 0.0], 0.0, "")], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, 1, [1.0, 0.0], 0.0, ""), (2, 1, [1.0, 0.0], 0.0, "")], SCHEMA)) == []


def test_rows_that_repeat_an_id_are_rows_of_their_own(spark):
    rows = [(0, 1, [1.0, 0.0], 0.0, "")] * 2 + [(1, 1, [1.0, 0.1], 0.0, "")] * 2 + [(2, 2, [0.5, 0.1], 0.0, "")] * 2
    got = mined(spark.createDataFrame(rows, SCHEMA))
    # two anchors, each with two positives, each with two negatives
    assert len(got) == 8 and {r[:2] for r in got} == {(0, 1)} and {r[3] for r in got} == {2}


def test_pruning_loses_nothing_and_does_prune(monkeypatch):
    rnd = np.random.default_rng(5)
    d, n = 8, 3000
    centres = rnd.normal(size=(40, d))
    x = np.rint(200 * (centres[rnd.integers(0, 40, n)] + 0.05 * rnd.normal(size=(n, d)))).astype(np.int64)
    rows = pd.DataFrame({"id": np.arange(n), "label": rnd.integers(0, 5, n), "ints": list(x)})
    anchors = rows.iloc[:30].assign(anchor=range(30), low=[[-negatives.NO_BAND]] * 30, high=[[negatives.NO_BAND]] * 30)
    seen, plain = [], negatives.Bucket.candidates

    def spy(self, *a):
        out = plain(self, *a)
        seen.append(len(self.ids) if out is None else len(out))
        return out

    monkeypatch.setattr(negatives.Bucket, "candidates", spy)
    got = negatives.search(anchors, rows, 5, True)
    scores = x[:30] @ x.T
    for i in range(30):
        fits = [j for j in range(n) if rows.label[j] == rows.label[i] and j != i]
        want = sorted(fits, key=lambda j: (-scores[i, j], j))[:5]
        mine = got[got.anchor == i].sort_values(["score", "id"], ascending=[False, True])
        assert mine.id.tolist() == want
    assert seen and sum(seen) < 0.5 * 30 * n


def test_scores_beyond_floating_point():
    big = np.array([[3_000_000_001, 1]], dtype=np.int64)
    assert negatives.exact_products(big, big).tolist() == [[3_000_000_001**2 + 1]]
    with pytest.raises(OverflowError):
        negatives.exact_products(big * 3, big * 3)
