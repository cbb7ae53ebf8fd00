"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and odd columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, chat, dedup_exact, licenses, lm, media, minhash, pack, quality, urls
from tidewatch.llm.queries import PLANTED, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def empty(docs):
    return docs.limit(0)


# 5 BPE


def reference_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(reference_ids, "tok"):
        reference_ids.tok = Tokenizer.from_file(tokenizer_path())
    return reference_ids.tok.encode(text or "", add_special_tokens=False).ids


def test_bpe_round_trip(docs, texts):
    for segment, leaf in ((1 << 18, 1 << 14), (100, 37)):
        ids = bpe.bpe_encode(docs, tokenizer_path(), segment=segment, leaf=leaf)
        out = bpe.bpe_decode(ids, tokenizer_path()).collect()
        assert len(out) == len(texts)
        for r in out:
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == reference_ids(texts[r.doc_id])
            assert r.decoded == (texts[r.doc_id] or "")
    assert bpe.bpe_encode(empty(docs), tokenizer_path()).count() == 0


def test_bpe_tree_agrees_at_any_cut():
    with open(tokenizer_path(), encoding="utf-8") as f:
        b = bpe.ByteBpe(f.read())
    rnd = random.Random(3)
    frag = ["'s", "'re", "'", "!!", " ", "  ", "\n", "\t", "the", " hello", "don't", "12", "é", "日本", "😀", "<|endoftext|>", "<|endo", "ftext|>", "\u00a0", "x" * 70, "ab" * 40, " " * 60, "-" * 30, "\r\n", "\u0301", "\u3000"]
    for _ in range(600):
        some = rnd.sample(frag, rnd.randint(1, 6)) if rnd.random() < 0.5 else frag
        text = "".join(rnd.choice(some) for _ in range(rnd.choice([3, 12, 40, 150])))
        assert np.frombuffer(b.encode([text], rnd.choice([1, 2, 5, 17, 64, 200]))[0], "<u4").tolist() == reference_ids(text)


# 9 packing


def test_packing(docs, texts):
    capacity = 64
    out = pack.pack_documents(docs, tokenizer_path(), capacity=capacity).collect()
    ids = {i: [*reference_ids(t), 2] for i, t in texts.items()}
    bins, seen = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        seen[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    for i, x in seen.items():
        x.sort()
        assert [p for p, _, _ in x] == list(range(len(x))) and sum(n for _, _, n in x) == len(ids[i])
        assert all(n == capacity for p, _, n in x if p)
    assert set(seen) == set(ids)
    for x in bins.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) <= math.ceil(sum(len(x) for x in ids.values()) / capacity) + 1
    assert pack.pack_documents(empty(docs), tokenizer_path()).count() == 0


def test_pack_keeps_odd_columns_and_rows(spark, monkeypatch):
    monkeypatch.setattr(pack, "SALT_ROWS", 3)
    rows = [(i % 7 if i % 5 else None, i % 3, 1 + i * 7 % 64, i) for i in range(300)] * 2
    df = spark.createDataFrame(rows, "doc_id int, piece int, length long, n int").withColumns({c: F.lit(1) for c in ("salt", "Rank", "start", "at", "offset", "sequence_id")})
    out = pack.pack(df, capacity=64)
    assert out.columns == ["doc_id", "piece", "length", "n", "salt", "Rank", "start", "at", "sequence_id", "offset"]
    got = out.collect()
    assert collections.Counter((r.doc_id, r.piece, r.length, r.n) for r in got) == collections.Counter(rows)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert all(at == sum(n for _, n in x[:k]) for k, (at, _) in enumerate(x)) and sum(n for _, n in x) <= 64
    assert pack.pack(df.limit(0)).count() == 0


def test_plans_are_near_optimal():
    rnd = random.Random(3)
    for _ in range(60):
        capacity = rnd.choice([10, 30, 100])
        counts = collections.Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(1, 60)))
        room = []
        for n in sorted(counts.elements(), reverse=True):
            fits = [k for k, r in enumerate(room) if r >= n]
            if fits:
                k = min(fits, key=lambda k: room[k])
                room[k] -= n
            else:
                room.append(capacity - n)
        h = pack.Histogram(counts, capacity)
        sets = pack.dominance(h) + pack.best_fit(h)
        assert sum(n for _, n in sets) <= len(room)  # never worse than best fit alone


# nulls in any column


def test_null_ids_and_columns(spark):
    rows = [(None, "a text of some words here"), (1, None), (2, "a text of some words here"), (None, None), (2**60 + 1, "another text with other words"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = tokenizer_path()
    ids = {r[0] for r in rows}
    for out in (
        dedup_exact.exact_dedup(df), bpe.bpe_decode(bpe.bpe_encode(df, path), path), lm.score_texts(df), lm.score_texts(df, broadcast_limit=0), minhash.near_duplicates(df), media.sniff(media.store_texts(df)),
        quality.score_quality(df, quality.fit_quality(df, df.selectExpr("doc_id", "cast(null as int) quality"))), pack.pack_documents(df, path),
    ):
        got = out.collect()
        assert len(got) == len(rows) and {r.doc_id for r in got} == ids
    assert licenses.scan_licences(df).count() == 0
    for f in (dedup_exact.drop_copies, minhash.drop_near_copies):
        out = f(df).collect()
        assert 2**60 + 1 in {r.doc_id for r in out} and out[0].asDict().keys() == {"doc_id", "text"}
    assert urls.judge_urls(spark.createDataFrame([(None, None)], "page_id long, url string"), urls.rule_table(spark)).count() == 1
