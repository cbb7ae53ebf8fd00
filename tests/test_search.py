"""Search by rarest runs of characters against plain search, over rows and over the stored index."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import search
from tidewatch.functions.text import containing
from tidewatch.operators.behavior import daily_digest
from tidewatch.sources.search_index import index_batch, look_up

R = random.Random(5)
TEXTS = {i: "".join(R.choice("ab c語😀") for _ in range(R.randrange(30))) for i in range(120)} | {120: None, 121: "", 122: "aaaa", 123: "aaaa"}
WORDS = sorted({t[i : i + n] for t in list(TEXTS.values())[:40] if t for i in range(0, len(t), 7) for n in (1, 2, 3, 5, 9)} | {"zz", "aaaaa", "語語語語"})
WANT = sorted((i, w) for i, t in TEXTS.items() for w in WORDS if t and w in t)


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def words(spark):
    return spark.createDataFrame([(w, "x") for w in [*WORDS, "", None]], "k string, note string")


@pytest.mark.parametrize("share", [100_000, 3])
def test_rarest_runs_find_what_plain_search_finds(spark, share, monkeypatch):
    monkeypatch.setattr(search, "SHARE", share)  # 3: every common run is split
    found = containing(table(spark, TEXTS), "text", words(spark), 0)
    assert found.columns == ["id", "text", "k", "note"]
    assert sorted((r.id, r.k) for r in found.collect()) == WANT
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_each_word_goes_by_its_rarest_run(spark):
    runs = search.word_runs(spark.createDataFrame([("abcd",), ("abx",), ("a",), ("abcd",), ("qqq",)], "k string"))
    assert sorted((r.k, r.gram) for r in runs.collect()) == [("a", "a"), ("abcd", "abc"), ("abcd", "bcd"), ("abx", "abx"), ("qqq", "qqq")]
    counts = spark.createDataFrame([("abc", 50), ("bcd", 2), ("abx", 7), ("a", 90)], "gram string, n long")
    assert sorted(map(tuple, search.rarest(runs, counts).collect())) == [("a", "a", 90), ("abcd", "bcd", 2), ("abx", "abx", 7)]


def test_index_of_batches_finds_what_plain_search_finds(spark, tmp_path):
    folder, rows = str(tmp_path / "index"), table(spark, TEXTS)
    for b in (0, 1, 2, 1):  # one batch twice
        index_batch(rows.filter(F.col("id") % 3 == b).withColumn("note2", F.lit(b)), folder, f"00{b}", 8)
    found = look_up(spark, folder, words(spark))
    assert sorted((r.id, r.k) for r in found.collect()) == WANT
    assert found.columns == ["id", "text", "note2", "batch", "k", "note"]
    assert {r.batch for r in found.select("batch").collect()} == {"000", "001", "002"}
    part = look_up(spark, folder, words(spark), ["001"])
    assert sorted((r.id, r.k) for r in part.collect()) == [x for x in WANT if x[0] % 3 == 1]
    assert look_up(spark, folder, words(spark).limit(0)).count() == 0


def test_a_batch_replaces_itself_alone(spark, tmp_path):
    folder = str(tmp_path / "index")
    k = spark.createDataFrame([("old",), ("new",), ("other",)], "k string")
    got = lambda: sorted((r.id, r.k) for r in look_up(spark, folder, k).collect())
    index_batch(table(spark, {1: "old text", 2: "old"}), folder, "a", 4)
    index_batch(table(spark, {1: "other text"}), folder, "b", 4)
    before = sorted(os.listdir(os.path.join(folder, "grams", "batch=b")))
    assert got() == [(1, "old"), (1, "other"), (2, "old")]
    index_batch(table(spark, {1: "new"}), folder, "a", 4)
    assert got() == [(1, "new"), (1, "other")]
    assert sorted(os.listdir(os.path.join(folder, "grams", "batch=b"))) == before


def test_digest_has_no_nested_loop_when_words_are_many(spark):
    sns = spark.createDataFrame([(i, f"why is {w}?", float(i)) for i, w in enumerate(["rain", "snow", "rainbow"])], "id long, keyword string, score double").withColumn("snapshot_at", F.lit("2024-01-30").cast("timestamp"))
    subs = spark.createDataFrame([(1, "RAIN", True), (2, "snow", True), (2, "sun", True), (3, "rain", False)], "user_id long, keyword string, alert_daily boolean")
    users = spark.createDataFrame([(1, True), (2, True), (3, True)], "user_id long, email_enabled boolean")
    few, many = (daily_digest(sns, subs, users, "2024-01-30 12:00:00", limit_bytes=b) for b in (1 << 20, 0))
    want = [(1, "rain", 1, 2), (1, "rain", 2, 0), (2, "snow", 1, 1)]
    for out in (few, many):
        assert sorted((r.user_id, r.keyword, r["rank"], r.id) for r in out.collect()) == want
    assert "NestedLoop" not in many._jdf.queryExecution().toString()
