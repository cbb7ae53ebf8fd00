import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle


def h(s):
    return sha256(s.encode()).hexdigest()


def tree(nodes):
    """Top and, for each node, (before, after) by level."""
    proofs, at, cur = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(cur) > 1:
        for k in range(len(proofs)):
            first = at[k] // 8 * 8
            run = cur[first : first + 8]
            proofs[k].append(("".join(run[: at[k] - first]), "".join(run[at[k] - first + 1 :])))
            at[k] //= 8
        cur = ["".join(cur[i : i + 8]) for i in range(0, len(cur), 8)]
        cur = [h(x) for x in cur]
    return cur[0], proofs


def brute(rows):
    """(lang, id, leaf) -> list of (subroot, root, proof)."""
    trees = {}
    for lang, i, leaf in rows:
        trees.setdefault(lang, []).append((i is not None, i or 0, leaf, i))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    parts = {lang: tree([leaf for _, _, leaf, _ in sorted(trees[lang], key=lambda x: x[:3])]) for lang in langs}
    root, above = tree([parts[lang][0] for lang in langs])
    out = []
    for lang, extra in zip(langs, above):
        top, proofs = parts[lang]
        for (_, _, leaf, i), p in zip(sorted(trees[lang], key=lambda x: x[:3]), proofs):
            out.append((i, leaf, top, root, tuple(p + extra)))
    return sorted(out, key=repr)


def made(df, **more):
    out = merkle.merkle_manifest(df, **more)
    rows = out.select("doc_id", "leaf", "subroot", "root", "proof", merkle.fold(F.col("leaf"), F.col("proof")).alias("folded"), merkle.siblings(F.col("proof")).alias("s")).collect()
    for r in rows:
        assert r.folded == r.root and r.s == h("".join(p.before + p.after for p in r.proof))
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.proof)) for r in rows), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {None: 65, "de": 64, "": 3, "é": 1, "z": 2}, {f"l{i}": 1 + i % 3 for i in range(20)}, {"en": 700, "fr": 5}])
def test_against_brute_force(spark, sizes):
    rnd = random.Random(4)
    rows = [(lang, rnd.randint(0, 10**6), h(f"{lang}{k}")) for lang, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(3).withColumns({"tree": F.lit(1), "at": F.lit("x"), "total": F.lit(2.0)})
    assert made(df) == brute(rows)
    if sum(sizes.values()) < 200:
        assert made(df, height=1) == brute(rows)  # many rounds of blocks of eight


def test_equal_rows_null_ids_and_nothing(spark):
    rows = [("en", None, h("a"))] * 30 + [("en", 3, h("b"))] * 30 + [("en", 3, h("c")), (None, None, h("d"))]
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string")
    assert made(df) == brute(rows)
    assert made(df.limit(0)) == []


def test_a_changed_field_changes_the_root(spark, docs):
    leaf = lambda text: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    df = docs.withColumn("leaf", leaf(F.col("text"))).withColumn("shown", leaf(F.upper("text")))
    out = merkle.merkle_manifest(df, carry=("shown",)).withColumn("again", merkle.fold(F.col("shown"), F.col("proof")))
    for r in out.collect():
        assert (r.again == r.root) == (r.shown == r.leaf)
    row = docs.filter("doc_id = 5").withColumn("leaf", leaf(F.col("text"))).first()
    e = lambda v: f"{len(str(v).encode())}:{v}"
    assert row.leaf == h(e(5) + e(row.source) + e(row.lang) + e(row.n_chars) + e(row.text))


def test_null_fields_and_long_texts(spark):
    df = spark.createDataFrame([(None, None, "é" * 2_000_000), (7, "", None)], "a long, b string, c string")
    got = [r[0] for r in df.select(merkle.leaf_digest(*(F.col(c) for c in "abc"))).collect()]
    assert got == [h("--4000000:" + "é" * 2_000_000), h("1:70:-")]


def test_heap_and_reversed_sweep_of_one_block():
    rnd = random.Random(6)
    for n in (1, 2, 8, 9, 63, 64, 65, 511, 513, 4096):
        leaves = [h(str(rnd.random())) for _ in range(n)]
        levels = merkle.sweep_up(leaves, n)
        top, proofs = tree(leaves)
        assert levels[-1] == [top] and [list(p) for p in merkle.sweep_down(levels, [])] == proofs
