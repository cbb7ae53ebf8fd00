"""Language-model scores against exact n-gram counts, and the mass that a context gives away."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import words

from tidewatch.llm import lm


def n_grams(tokens):
    """Every n-gram (tuple) that ends in each token; the start of a text is one word before its first."""
    x = ["<s>", *tokens]
    return [[tuple(x[i - n + 1 : i + 1]) for n in range(2, lm.ORDERS + 1) if i - n + 1 >= 0] for i in range(1, len(x))]


def level(c):
    return c.bit_length()


@pytest.mark.parametrize("routed", [False, True])
def test_lm(docs, texts, routed, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT_CHARS", 9000)
    monkeypatch.setattr(lm, "BLOCK_CHARS", 8000)
    out = lm.score_texts(docs, broadcast_limit=0 if routed else lm.BROADCAST).collect()
    toks = {i: [*words(t), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = collections.Counter(w for i in toks if not held[i] for w in toks[i])
    seen = collections.Counter(g for i in toks if not held[i] for x in n_grams(toks[i]) for g in x)
    n, v, starts = sum(c.values()), len(c), sum(not h for h in held.values())
    assert len(out) == len(texts)
    off = []
    for r in out:
        t = toks[r.doc_id]
        p = {w: (c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t}
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, held[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10(p[w]) for w in t), abs=1e-6)
        exact = 0.0
        for w, ending in zip(t, n_grams(t)):
            q = p[w]
            for g in ending:
                if len(g) == 2:
                    have = starts if g[0] == "<s>" else c[g[0]]
                else:
                    have = 2 ** level(seen[g[:-1]]) - 1
                low = 2 ** (level(seen[g]) - 1) if seen[g] else 0
                q = (min(low, have, c[w]) + lm.K * q) / (have + lm.K)
            exact += math.log10(q)
        off.append(abs(r.score - exact) / len(t))
    assert np.mean(off) < 0.02 and np.median(off) < 1e-3  # only the filter's false positives differ
    assert lm.score_texts(docs.limit(0)).count() == 0


def test_both_ways_agree(docs):
    a, b = ({r.doc_id: r.score for r in lm.score_texts(docs, broadcast_limit=limit).collect()} for limit in (0, lm.BROADCAST))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-12) for i in a)


def test_masses_of_a_context_sum_to_at_most_one():
    """Over the whole vocabulary, after every context that occurs, and after ones that do not."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(25)]
    texts = [" ".join(rnd.choices(vocabulary, weights=range(1, 26), k=rnd.randint(1, 40))) for _ in range(60)]
    texts += ["a " + x for x in vocabulary for _ in range(2)]  # 25 successors, each seen twice
    raw = [t.encode() for t in texts]
    word, own, place = lm.tokens(raw)
    keys, there = lm.grams(word, place, 40)
    table, n = lm.tallied(keys[there])
    kinds, count = lm.tallied(word)
    t = lm.Totals(len(word), len(kinds), len(raw), 40)
    for context in [rnd.choice(texts).split()[: rnd.randint(0, 6)] for _ in range(40)] + [["a"], ["never", "seen"]]:
        tried = [" ".join([*context, x]).encode() for x in [*vocabulary, "a", "new"]]
        mass = 0.0
        for raw_, at in [(x, len(context)) for x in tried] + [(" ".join(context).encode(), len(context))]:  # the last: the end
            w, _, pl = lm.tokens([raw_])
            k, ok = lm.grams(w, pl, 40)
            levels = np.zeros(k.shape, np.uint8)
            levels[ok] = lm.level_of(lm.find(k[ok], table, n))  # what a filter without false positives says
            mass += lm.probabilities(lm.find(w, kinds, count).astype(float), levels, pl, t)[1][at]
        assert mass <= 1 + 1e-9


def test_repeated_text_is_told_apart(spark):
    """Held-out copies of a text that was learned from score above held-out texts of the same words."""
    rnd = random.Random(9)
    vocabulary = [f"w{int(rnd.paretovariate(0.7)) % 900}" for _ in range(4000)]
    text = lambda: " ".join(rnd.choices(vocabulary, k=80))
    rows = [(i, text(), False) for i in range(1500)]
    rows += [(2000 + i, rows[i][1], True) for i in range(40)] + [(3000 + i, text(), True) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in lm.score_texts(df, exclude=F.col("held")).collect()}
    assert min(got[2000 + i] for i in range(40)) > max(got[3000 + i] for i in range(40))


@pytest.mark.parametrize("stored", [False, True])
def test_equal_rows_part_over_blocks(spark, monkeypatch, tmp_path, stored):
    rows = spark.range(4000).selectExpr("cast(null as long) doc_id", "'' text").unionByName(spark.createDataFrame([(i, "some words here") for i in range(50)], "doc_id long, text string"))
    if stored:
        rows.withColumn("_metadata", F.lit("a column of this name")).write.parquet(str(tmp_path / "docs"))
        rows = spark.read.parquet(str(tmp_path / "docs"))
    assert (lm._place(rows) is not None) == stored
    seen = []
    dealt = lm._dealt

    def spy(df, key, kinds):
        if key == "block":
            seen.append(df)
        return dealt(df, key, kinds)

    monkeypatch.setattr(lm, "BLOCK_CHARS", 30)
    monkeypatch.setattr(lm, "_dealt", spy)
    routed = lm.score_texts(rows, broadcast_limit=0).groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("a"), F.max("score").alias("b")).collect()
    sizes = [r["count"] for r in seen[0].groupBy("block").count().collect()]
    assert sum(sizes) == 4050 and max(sizes) < 4 * 4050 / len(sizes)
    plain = {r.doc_id: r.score for r in lm.score_texts(rows).collect()}
    assert len(routed) == 51 and {r.doc_id: r.n for r in routed}[None] == 4000
    assert all(r.a == r.b == pytest.approx(plain[r.doc_id], abs=1e-9) for r in routed)


def test_size_is_checked_before_it_is_sent(spark, docs, monkeypatch):
    """An estimate that is too low does not lead to a broadcast."""
    sent = []
    monkeypatch.setattr(lm, "_by_broadcast", lambda *a: sent.append(a))
    monkeypatch.setattr(lm, "SAMPLE", 1 << 40)  # hardly a key is sampled, so the filter seems to be empty
    limit = 16 * (docs.selectExpr("explode(split(lower(text), '[ \\t\\n\\x0b\\f\\r]+')) w").distinct().count() + 2)
    assert lm.score_texts(docs, broadcast_limit=limit).count() == docs.count() and not sent


def test_hashes_do_not_depend_on_steps(monkeypatch):
    from tidewatch.llm import hashing

    r = random.Random(3)
    cases = [[bytes(r.choice(b"ab \n\tc") for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(r.randrange(6))] for _ in range(100)] + [[b"x" * 500, b"", b"y " * 300]]
    want = [hashing.words(t) for t in cases]
    for step in (1, 3, 64):
        monkeypatch.setattr(hashing, "STEP", step)
        monkeypatch.setattr(hashing, "_POWERS", [])
        for t, (h, o) in zip(cases, want):
            got = hashing.words(t)
            assert np.array_equal(got[0], h) and np.array_equal(got[1], o)
    for t, (h, o) in zip(cases, want):
        flat = [w for x in t for w in x.split()]
        assert len(flat) == len(h) and len(set(flat)) == len(set(h.tolist()))
