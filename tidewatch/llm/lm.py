"""Language-model scores: n-grams of two to four words whose quantised counts stand in a log-frequency Bloom filter.

An n-gram seen c times is put in once for each level 1 .. 1 + log2(c); probing levels until one is missing gives its
level back, never too low and rarely too high. With h the words before w and h' all of them but the first,

    p(w | h) = (low(h w) + K p(w | h')) / (up(h) + K)

where low is the least and up the largest count of a level; the counts of single words are exact, and p(w) is their
add-0.1 estimate. The least counts of what follows h sum to at most c(h), which is at most up(h), so the masses of a
context sum to at most 1, but for the filter's false positives (about 4 in 1,000 probes; an n-gram counts only where
both the n-grams of one word less inside it are found too, so that few of them matter beyond pairs).

The filter is built in segments by key, each by one task from the keys of that segment. Its bytes are measured first, on
a sample of the keys by hash over the whole corpus, and a filter under a limit is broadcast. A larger one would not fit
every worker and the driver, so its segments stay where they are built: blocks of documents send each their distinct
keys, once, with their training counts, and get levels back. Both ways probe the same bits and give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.hashing import U, chunks, mix, words
from tidewatch.runtime import forget, written

ORDERS, K = 4, 2.0
#: Bits of the filter for each item, all probes of an item inside one word of 64; characters for one segment and block.
BITS, PROBES, SEGMENT_CHARS, BLOCK_CHARS = 16, 5, 8_000_000, 8_000_000
#: Most bytes of the filter and the word counts that are broadcast; one of SAMPLE keys is counted to estimate them.
BROADCAST, SAMPLE = 64 << 20, 64
#: Bits of a key beyond those that number all n-grams there can be: under 1 in 2^10 n-grams shares its key with another.
SPARE = 10
#: Up to so many tasks, blocks and segments get two each, as two or three of them in one would take longest.
TASKS = 2000
FLUSH = 2_000_000
END, START = U(0x7F4A7C159E3779B9), U(0x1CE4E5B9BF58476D)
LOW = np.concatenate([[0.0], 2.0 ** np.arange(64)])
UP = np.concatenate([[0.0], 2.0 ** np.arange(1, 65) - 1])


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) == 0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and end tokens, the index of the text of each, and its place there."""
    h, owner = words(texts)
    n = len(texts)
    word, own = np.full(len(h) + n, END, U), np.zeros(len(h) + n, np.int64)
    at = np.arange(len(h)) + owner  # every text before has put in an end
    word[at], own[at] = h, owner
    sizes = np.bincount(owner, minlength=n) + 1
    ends = np.cumsum(sizes)
    own[ends - 1] = np.arange(n)
    return word, own, np.arange(len(word)) - np.repeat(ends - sizes, sizes)


def grams(word: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end in each token, a row for each order from 2 on, and which of them there are: the start
    of a text stands as one word before its first."""
    keys, there = np.zeros((ORDERS - 1, len(word)), U), np.zeros((ORDERS - 1, len(word)), bool)
    last = word
    for k in range(ORDERS - 1):
        before = np.empty_like(word)
        before[1:], before[:1] = last[:-1], START
        if not k:
            before[place == 0] = START
        last = mix(before * U(0x9E3779B97F4A7C15) + mix(word + U(k + 1)))
        keys[k], there[k] = last >> U(64 - bits), place >= k
    return keys, there


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys.astype(U), counts.astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`counted` with ones, which need not be sorted along."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + log2, exactly; 0 for 0."""
    return np.frexp(counts.astype(float))[1] * (counts > 0)


def probe(keys: np.ndarray, level: int, size) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter for each key at a level, among ``size`` (up to 2^32), and the bits it must have."""
    h = mix(keys + np.array([level], U) * U(0xD1B54A32D192ED03))
    mask = U(1) << (h & U(63))
    for k in range(1, PROBES):
        mask |= U(1) << ((h >> U(6 * k)) & U(63))
    return (((h >> U(32)) * size) >> U(32)).astype(np.int64), mask


def filter_bits(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The words of one segment."""
    level = level_of(counts)
    out = np.zeros(max(1, -(-int(level.sum()) * BITS // 64)), U)
    for k in range(1, int(level.max(initial=0)) + 1):
        at, mask = probe(keys[level >= k], k, U(len(out)))
        np.bitwise_or.at(out, at, mask)
    return out.tobytes()


class Filter:
    """Segments, laid one behind another; a key's first bits choose its segment."""

    def __init__(self, segments: list[bytes], bits: int):
        self.shift = U(bits - (len(segments).bit_length() - 1))
        self.words = np.frombuffer(b"".join(segments), U)
        sizes = np.array([len(s) // 8 for s in segments], np.int64)
        self.start, self.size = np.cumsum(sizes) - sizes, sizes.astype(U)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 for keys that are not in; levels are probed upwards until one is missing."""
        out, open_, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1
        while len(open_) and level < 64:
            own = keys[open_]
            if len(self.size) > 1:
                segment = (own >> self.shift).astype(np.int64)
                at, mask = probe(own, level, self.size[segment])
                at += self.start[segment]
            else:
                at, mask = probe(own, level, self.size[0])
            open_ = open_[self.words[at] & mask == mask]
            out[open_] = level
            level += 1
        return out


def find(keys: np.ndarray, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, counts[at], 0)


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct ones and texts, and the bits of n-gram keys."""

    n: int
    v: int
    starts: int
    bits: int


def probabilities(c: np.ndarray, levels: np.ndarray, place: np.ndarray, t: Totals) -> tuple[np.ndarray, np.ndarray]:
    """p(w) and p(w | h) of each token from word counts and the levels of the n-grams that end in it."""
    base = p = (c + 0.1) / (t.n + 0.1 * (t.v + 1))
    first = place == 0
    for k in range(ORDERS - 1):
        context = np.zeros(len(c))
        context[1:] = c[:-1] if not k else UP[levels[k - 1, :-1]]
        context[first] = t.starts if not k else 0
        low = np.minimum(np.minimum(LOW[levels[k]], context), c)
        if k:
            low[levels[k - 1] == 0] = 0  # what was never seen without its first word was not seen with it
        p = (low + K * p) / (context + K)
    return base, p


def scored(texts: list[bytes], tokens_: tuple, c: np.ndarray, levels: np.ndarray, t: Totals) -> pd.DataFrame:
    _, own, place = tokens_
    base, p = probabilities(c.astype(float), levels, place, t)
    per_text = lambda x: np.bincount(own, x, minlength=len(texts))
    return pd.DataFrame({
        "n_tokens": np.bincount(own, minlength=len(texts)), "n_known": per_text(c > 0).astype(np.int64), "train_tokens": t.n,
        "base_score": per_text(np.log10(base)), "score": per_text(np.log10(p)),
    })


def squeeze(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Integers, or the steps between sorted ones, byte plane by byte plane, compressed."""
    import zstandard

    if sorted_ and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(raw: bytes, kind: type, sorted_: bool = False) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if sorted_ else values


def cut(keys: np.ndarray, segments: int, bits: int) -> np.ndarray:
    """Where each segment begins in sorted keys of so many bits, and the end."""
    if segments == 1:
        return np.array([0, len(keys)])
    edges = np.arange(1, segments, dtype=U) << U(bits - (segments.bit_length() - 1))
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def packed(words_: tuple, pairs: tuple, segments: int, bits: int) -> list[tuple]:
    """A row for each segment: the sorted keys and counts of words and n-grams that fall into it."""
    a, b = cut(words_[0], segments, 64), cut(pairs[0], segments, bits)
    put = lambda kc, i, j: (squeeze(kc[0][i:j], True), squeeze(kc[1][i:j].astype(np.uint32)))
    return [(s, *put(words_, a[s], a[s + 1]), *put(pairs, b[s], b[s + 1])) for s in range(segments) if a[s] < a[s + 1] or b[s] < b[s + 1]]


PACKED = ["segment", "words", "word_n", "grams", "gram_n"]
PACKED_TYPE = "segment long, words binary, word_n binary, grams binary, gram_n binary"
SCORED = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sums(x: pd.DataFrame, key: str, n: str) -> tuple[np.ndarray, np.ndarray]:
    return counted(np.concatenate([spread(b, U, True) for b in x[key]]), np.concatenate([spread(b, np.uint32) for b in x[n]]).astype(np.int64))


def _text(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    for x in parts:
        for start, texts in chunks(x["text"].tolist()):
            yield x.iloc[start : start + len(texts)], texts


def count_corpus(rows: DataFrame, segments: int, bits: int, sample: int = 1) -> DataFrame:
    """Packed training counts of words, and of one of ``sample`` n-grams, by key; a row for each segment, task and about
    FLUSH tokens."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pd.DataFrame:
            both = [tallied(np.concatenate([h[i] for h in held])) for i in (0, 1)]
            held.clear()
            return pd.DataFrame(packed(*both, segments, bits), columns=PACKED)

        for x, texts in _text(parts):
            word, own, place = tokens(texts)
            learn = ~x["held_out"].to_numpy(bool)[own]
            keys, there = grams(word, place, bits)
            keys = keys[there & learn]
            held.append((word[learn], keys if sample == 1 else keys[keys % U(sample) == 0]))
            if sum(len(h[0]) for h in held) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return rows.select("text", "held_out").mapInPandas(run, PACKED_TYPE)


def build_segments(counts: DataFrame) -> DataFrame:
    """By segment: word keys and counts, the filter's words, tokens, distinct tokens, texts, and levels put in."""

    def build(x: pd.DataFrame) -> pd.DataFrame:
        w, n = _sums(x, "words", "word_n")
        keys, seen = _sums(x, "grams", "gram_n")
        row = (x["segment"].iloc[0], w.tobytes(), n.tobytes(), filter_bits(keys, seen), int(n.sum()), len(w), int(n[w == END].sum()), int(level_of(seen).sum()))
        return pd.DataFrame([row], columns=["segment", "words", "word_n", "bits", "tokens", "kinds", "ends", "levels"])

    return counts.groupBy("segment").applyInPandas(build, "segment long, words binary, word_n binary, bits binary, tokens long, kinds long, ends long, levels long")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exclude: Column | None = None, broadcast_limit: int = BROADCAST) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from the rows that ``exclude`` (a condition) does not name. A-Z are lowered; a text is its words and one end.
    Null text: empty, its end alone. Repeated rows are scored alike and count each. Null ids are held out if the
    condition says so, else learned from. A very long text is one task's, whole, and its words are hashed in steps. Equal rows part over blocks like any. Other
    columns are ignored. An empty table gives an empty table; without rows to learn from, N is 0 and every token is
    unknown. At any size all rows are counted and scored; only how the filter reaches the texts depends on its bytes
    (``broadcast_limit``)."""
    kind = docs.schema[id_col].dataType.simpleString()
    out_held = F.coalesce(held_out(id_col) if exclude is None else exclude, F.lit(False))
    place = _place(docs)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), out_held.alias("held_out"), *([] if place is None else [place.alias("row")]))
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    chars = size["chars"] or 0
    segments = 1 << max(0, int(np.ceil(np.log2(max(chars, 1) / SEGMENT_CHARS))))
    bits = min(64, int(np.ceil(np.log2((ORDERS - 1) * (chars / 2 + size["n"]) + 1))) + SPARE)
    model = written(build_segments(count_corpus(rows, segments, bits, SAMPLE)), "lm-words")
    total = model.agg(F.sum("tokens"), F.sum("kinds"), F.sum("ends"), F.sum("levels")).first()
    n, v, starts, levels = (int(x or 0) for x in total)
    totals = Totals(n, v, starts, bits)
    if levels * SAMPLE * BITS / 8 + 16 * v <= broadcast_limit:
        forget(model)
        model = written(build_segments(count_corpus(rows, segments, bits)), "lm-segments")
        built = model.agg(F.sum(F.length("bits") + F.length("words") + F.length("word_n"))).first()[0] or 0
        fits = built <= broadcast_limit  # what is sent is what was measured, not what was estimated
    else:
        fits = False
    if fits:
        out = _by_broadcast(rows, model, segments, totals)
    else:
        out = _by_routing(rows, model, segments, max(1, chars // BLOCK_CHARS), totals)
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])


def _place(docs: DataFrame) -> Column | None:
    """A number for each row by its place in its Parquet file, which every reading gives again; None for other tables."""
    try:
        m = docs.metadataColumn("_metadata")
        place = F.xxhash64(m["file_path"], m["row_index"])
        docs.select(place)  # says whether there is one
    except AnalysisException:
        return None
    return place


def _with_ids(x: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([x[["id", "held_out"]].reset_index(drop=True), s], axis=1)


def _by_broadcast(rows: DataFrame, model: DataFrame, segments: int, t: Totals) -> DataFrame:
    got = {r["segment"]: r for r in model.select("segment", "words", "word_n", "bits").toLocalIterator()}  # measured by the caller
    part = lambda k, none: [bytes(got[s][k]) if s in got else none for s in range(segments)]
    sent = rows.sparkSession.sparkContext.broadcast((b"".join(part("words", b"")), b"".join(part("word_n", b"")), part("bits", b"\0" * 8)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, c, bits = sent.value
        w, c, f = np.frombuffer(w, U), np.frombuffer(c, np.int64), Filter(bits, t.bits)
        for x, texts in _text(parts):
            own = tokens(texts)
            keys, there = grams(own[0], own[2], t.bits)
            levels = np.zeros(keys.shape, np.uint8)
            levels[there] = f.levels(keys[there])
            yield _with_ids(x, scored(texts, own, find(own[0], w, c), levels, t))

    return rows.select("id", "text", "held_out").mapInPandas(run, SCORED)


def _dealt(rows: DataFrame, key: str, kinds: int) -> DataFrame:
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * kinds, TASKS)), key)


def _by_routing(rows: DataFrame, model: DataFrame, segments: int, blocks: int, t: Totals) -> DataFrame:
    """Rows are dealt by number, so that equal ones part; blocks, segments and the messages between them hold about as many
    keys at every size of the corpus. Rows are read twice and must have the same number then, so those that no Parquet
    file places are written with one."""
    numbered = rows if "row" in rows.columns else written(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    blocked = _dealt(numbered.select("id", "text", "held_out", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")), "block", blocks)

    def of_block(x: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts by chunk with their tokens; words, keys, and which keys there are and count, of the whole block."""
        learn, texts, word, keys, there = ~x["held_out"].to_numpy(bool), [], [], [], []
        for start, t_ in chunks(x["text"].tolist()):
            own = tokens(t_)
            texts.append((t_, own, learn[start + own[1]]))
            k, ok = grams(own[0], own[2], t.bits)
            word.append(own[0])
            keys.append(k)
            there.append(ok)
        return texts, np.concatenate(word), np.concatenate(keys, axis=1), np.concatenate(there, axis=1), np.concatenate([y[2] for y in texts])

    def ask(x: pd.DataFrame) -> pd.DataFrame:
        _, word, keys, there, learn = of_block(x)
        counts = np.broadcast_to(learn, keys.shape)[there].astype(np.int64)
        rows_ = packed((np.unique(word), np.zeros(0, np.int64)), counted(keys[there], counts), segments, t.bits)
        return pd.DataFrame([(x["block"].iloc[0], r[0], r[1], r[3], r[4]) for r in rows_], columns=["block", "segment", "words", "grams", "gram_n"])

    def answer(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        m = held.iloc[0] if len(held) else {"words": b"", "word_n": b""}
        w, c = np.frombuffer(m["words"], U), np.frombuffer(m["word_n"], np.int64)
        k, n_ = _sums(asked, "grams", "gram_n")
        f = Filter([filter_bits(k[n_ > 0], n_[n_ > 0])], t.bits)
        out = [(b, key[0], squeeze(find(spread(x, U, True), w, c)), squeeze(f.levels(spread(y, U, True)))) for b, x, y in zip(asked["block"], asked["words"], asked["grams"])]
        return pd.DataFrame(out, columns=["block", "segment", "word_n", "levels"])

    def score(key, docs_: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        texts, word, keys, there, _ = of_block(docs_)
        got = got.sort_values("segment")
        c, level = np.concatenate([spread(b, np.int64) for b in got["word_n"]]), np.concatenate([spread(b, np.uint8) for b in got["levels"]])
        c = c[np.unique(word, return_inverse=True)[1]]
        levels = np.zeros(keys.shape, np.uint8)
        levels[there] = level[np.unique(keys[there], return_inverse=True)[1]]
        out, at = [], 0
        for t_, own, _ in texts:
            end = at + len(own[0])
            out.append(scored(t_, own, c[at:end], levels[:, at:end], t))
            at = end
        return _with_ids(docs_, pd.concat(out, ignore_index=True))

    asked = blocked.groupBy("block").applyInPandas(ask, "block long, segment long, words binary, grams binary, gram_n binary")
    answers = _dealt(asked, "segment", segments).groupBy("segment").cogroup(model.select("segment", "words", "word_n").groupBy("segment")).applyInPandas(answer, "block long, segment long, word_n binary, levels binary")
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, SCORED)
