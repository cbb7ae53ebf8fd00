"""Near-duplicates against all pairs: chains, families, odd ids and names."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import words

from tidewatch.llm import minhash
from tidewatch.llm.hashing import U
from tidewatch.llm.skew import salted_join


def components(texts, n):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sets, {i: root(i) for i in texts}


@pytest.mark.parametrize("n, limit", [(4, 32 << 20), (5, 32 << 20), (4, 0)])
def test_near_duplicates(docs, texts, n, limit):
    sets, label = components(texts, n)
    out = minhash.near_duplicates(docs, shingle=n, broadcast_limit=limit).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == {i: (len(sets[i]), label[i], label[i] == i) for i in texts} and len(out) == len(texts)


def test_near_duplicates_chains_and_hot_groups(spark):
    """A group in which most pairs are under the threshold and no member is near all others."""
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for i in range(160):
        w = list(base)
        for k in rnd.sample(range(150), rnd.randint(0, 7)):
            w[k] = f"v{rnd.randint(0, 99999)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, label = components(texts, 4)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle=4).collect()} == label
    assert len(set(label.values())) > 3
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(1)
    for size, share in ((3, 0.5), (40, 0.8), (3000, 0.3)):
        both = rnd.integers(1, 1 << 62, 2 * size, dtype=np.uint64)
        k = int(size * share)
        a, b = both[:size], np.concatenate([both[:k], both[size : 2 * size - k]])
        s = minhash.sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert (s != ~np.uint64(0)).all()
        assert abs((s[0] == s[1]).mean() - k / (2 * size - k)) < 0.2


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)


def labels(docs, **options):
    return {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle=4, **options).collect()}


def test_versions_that_overlap_only_their_neighbours(spark):
    """A hundred versions of a page, ids in order: each links to the next, none to those further on."""
    line = [f"w{k}" for k in range(700)]
    texts = {i: " ".join(line[6 * i : 6 * i + 100]) for i in range(100)}
    _, want = components(texts, 4)
    assert set(want.values()) == {0} and labels(table(spark, texts)) == want


@pytest.mark.parametrize("block", [minhash.BLOCK, 1000])
def test_families(spark, block, monkeypatch):
    """A long passage that many texts share without being similar, a family around the threshold, and long texts."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "OTHERS", 2 * block)
    rnd = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    texts = {i: " ".join(passage + [f"q{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(20, 90))]) for i in range(120)}
    base = [f"b{k}" for k in range(120)]
    for i in range(200, 300):
        w = list(base)
        for k in rnd.sample(range(120), rnd.randint(0, 6)):
            w[k] = f"c{rnd.randint(0, 30)}"
        texts[i] = " ".join(w)
    long = [f"l{k}" for k in range(30_000)]
    texts |= {400: " ".join(long), 401: " ".join(long[:29_000]), 402: " ".join(long[3000:] + base), 403: " ".join(long[15_000:])}
    _, want = components(texts, 4)
    assert labels(table(spark, texts)) == want and len(set(want.values())) > 100


def test_joining_links_finds_what_all_pairs_do():
    rnd = np.random.default_rng(5)
    for _ in range(60):
        base = rnd.integers(1, 1 << 60, 40, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rnd.choice(base, rnd.integers(1, 41), replace=False), rnd.integers(1, 1 << 60, rnd.integers(0, 8), dtype=np.uint64)])) for _ in range(14)]
        rows = [(i, i, s.astype(U)) for i, s in enumerate(sets)]
        percent = int(rnd.choice([50, 80, 100]))
        parent = list(range(14))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for (a, _, x), (b, _, y) in itertools.product(rows[:6], rows):
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                parent[root(a)] = root(b)
        want = {frozenset(i for i in range(14) if root(i) == r) for r in map(root, range(14))}
        parent = list(range(14))
        for a, b in minhash.joining_links(rows[:6], rows, percent):
            parent[root(a)] = root(b)
        assert {frozenset(i for i in range(14) if root(i) == r) for r in map(root, range(14))} == want


def test_string_ids_repeats_and_clashes(spark, texts):
    rows = [(str(i), t) for i, t in texts.items()] + [(None, texts[0]), (None, None), ("0", texts[0])]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(1) for c in ("id", "key", "kept", "Kept_", "n", "members")})
    _, want = components({str(i): t for i, t in texts.items()}, 4)
    got = minhash.near_duplicates(df, shingle=4).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    kept = minhash.drop_near_copies(df, shingle=4)
    # without shingles every row stays, also one without an id, and rows that share an id stay together
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values()) | {None}


def test_salted_join(spark):
    rows = spark.createDataFrame([(k % 5 if k % 2 else 77, k) for k in range(400)] + [(None, -1)], "k int, v int")
    groups = rows.filter("k is not null and k <> 3").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, rows.join(groups, "k").collect()))
    for least in (1, 30, 1000):
        got = salted_join(rows, groups, "k", "n", 400, ["v"], hot=1000, least=least)
        assert got.columns == ["k", "v", "n"] and sorted(map(tuple, got.collect())) == want
