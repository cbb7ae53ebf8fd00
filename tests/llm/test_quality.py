"""Quality scores against sizes compressed here, and held-out accuracy."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import quality


def test_quality(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["the", "a", "river", "runs", "over", "hills", "and", "meadows"]) for _ in range(60)) + "."
    bad = lambda: " | ".join(rnd.choice(["BUY", "###", "$$$", "NOW!!", "%%%"]) + str(rnd.randint(0, 9)) for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)] + [(900, None), (901, ""), (902, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_y", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(5, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, exclude=quality.held_out())
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i] >= 0.7) == (i % 4 > 0) for i in held) and len(held) > 50
    assert got[900] == got[901] == pytest.approx(model.prior) and 0 <= got[902] <= 1
    none = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, none).collect() if r.doc_id == 900} == {0.5}


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_quality(docs, labels, exclude=quality.held_out())
    rows = quality.score_quality(docs, model).join(labels, "doc_id").filter(quality.held_out()).select("score", "quality").collect()
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in rows)
    assert len(rows) > 60 and right / len(rows) > 0.9


def test_scores_by_hand(docs, texts):
    """The compressed sizes alone decide: no length, language or other column."""
    import zstandard as z

    model = quality.QualityModel(b"the of a code " * 30 + texts[0].encode(), b"changed1 changed2 \xc3\x9cber7 " * 20, 0.3, 5.0, 0.6)
    out = {r.doc_id: r.score for r in quality.score_quality(docs.withColumn("score", F.lit("gives way")), model).collect()}
    assert len(out) == len(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        bad, good = (len(z.ZstdCompressor(level=9, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(raw)) for d in (model.bad, model.good))
        want = 1 / (1 + math.exp(-(0.3 + 5.0 * (bad - good) / (len(raw) + quality.NORM)))) if raw else 0.6
        assert out[i] == pytest.approx(want, abs=1e-12)


def test_fit_by_hand(spark):
    """The sample, the dictionaries and the calibration, found again without Spark."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_quality(docs, labels, exclude=quality.held_out(), sample_chars=4000)
    rows = docs.join(labels, "doc_id").filter("length(text) <= 4000 and quality is not null").select("doc_id", "text", "quality", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()
    rows = sorted((r.h, r.doc_id, r.text, r.quality) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    sides = [[t for _, _, t, q in rows if q == y] for y in (0, 1)]
    assert (model.bad, model.good) == tuple(quality.dictionary(x) for x in sides)
    tune = []
    for fold in range(quality.FOLDS):
        bad, good = (quality.dictionary([t for k, t in enumerate(x) if k % quality.FOLDS != fold]) for x in sides)
        of = quality.QualityModel(good, bad, 0.0, 0.0, 0.5).difference()
        tune += [(of(t), y) for y in (0, 1) for t in sides[y][fold :: quality.FOLDS]]
    n = [sum(y == k for _, y in tune) for k in (0, 1)]

    def loss(offset, slope):
        total = 0.0
        for x, y in tune:
            p = 1 / (1 + math.exp(-(offset + slope * x)))
            total -= (model.prior / n[1] if y else (1 - model.prior) / n[0]) * math.log(p if y else 1 - p)
        return total

    best = loss(model.offset, model.slope)
    assert all(loss(model.offset * a, model.slope * b) >= best - 2e-3 for a in (0.7, 1, 1.4) for b in (0.7, 1, 1.4))


def test_odd_tables(docs):
    model = quality.QualityModel(b"good text", b"bad text", 0.0, 1.0, 0.5)
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert quality.score_quality(docs.unionByName(docs), model).count() == 2 * docs.count()
