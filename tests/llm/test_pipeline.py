"""The corpus pipeline's stages against brute force on the smallest table, and the SQL of queries that have one."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from test_minhash import components  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in out.collect()}
        docs = spark.createDataFrame(out.collect(), docs.schema)
    by = {}
    for i, t in kept["quality"].items():
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    best = {min(x, key=lambda i: (-len(kept["quality"][i] or ""), i)) for x in by.values()}
    assert set(kept["exact_dedup"]) == best
    _, label = components(kept["exact_dedup"], 5)
    assert set(kept["near_dedup"]) == set(label.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(kept["near_dedup"])


def test_run_is_the_stages_one_after_another(spark):
    """run() gives the pieces of what the stages keep, each document whole, in sequences without gaps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    want = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want) > 100
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at == sum(n for _, n in sorted(x)[:k]) for x in bins.values() for k, (at, _) in enumerate(sorted(x)))


def test_quality_stage_by_hand(spark):
    """The rows whose scores, computed here from the model's dictionaries, reach the threshold, are those that stay."""
    import math

    from tidewatch.llm import quality

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels, exclude=quality.held_out())
    of = model.difference()
    score = lambda t: 1 / (1 + math.exp(-(model.offset + model.slope * of(t)))) if t else model.prior
    want = {r.doc_id for r in docs.collect() if score(r.text) >= corpus_pipeline.KEEP_FROM}
    assert {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()} == want and 0 < len(want) < docs.count()


def test_stages_on_odd_tables(spark):
    """Nulls, empty texts, repeats and clashing names go through every stage; empty tables stay empty."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (None, "a b c d e f"), (10**9, ""), (10**9 + 1, None), (10**9 + 2, "x " * 50_000)], "doc_id long, text string")
    names = ("score", "kept", "key", "id", "salt", "n", "members", "_quality", "_kept")
    docs = docs.limit(60).unionByName(odd, allowMissingColumns=True).unionByName(odd, allowMissingColumns=True).withColumns({n: F.lit(1) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_chat_query_digests(spark):
    from tidewatch.llm import queries

    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = {r.conv_id: r for r in queries.op1_chat_format(spark, SF).collect()}
    for c in {r.conv_id for r in rows}:
        turns = sorted((r.turn, r.role, r.text or "") for r in rows if r.conv_id == c)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
    assert got[-1].loss_chars == len(queries.PLANTED)
