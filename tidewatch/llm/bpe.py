"""Byte-level BPE: encoding by tree concatenation, and decoding.

A text is cut into leaves; the leaves are encoded on their own, and neighbours are joined pairwise up a tree. At each
join a window of tokens around the seam is encoded again and grown until it agrees with both sides. Tokens of a BPE
encoding stay an encoding wherever every two neighbours are one, so agreement of two tokens on each side, away from the
seam, proves that the joined ids are those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a match of the splitting pattern, or a special token, may look past a cut.
MARGIN = 48
#: Fixed value: the splitting pattern of a byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENT, LEAF = 1 << 18, 1 << 14
_LOADED: dict[tuple, "ByteBpe"] = {}


def _byte_chars() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """A tokenizer of the tokenizers library, from the text of its file."""

    def __init__(self, definition: str, encodes: bool = True):
        """With ``encodes`` off only the bytes of the tokens are kept, for decoding."""
        d = json.loads(definition)
        chars, added = _byte_chars(), {x["content"]: x["id"] for x in d.get("added_tokens", [])}
        vocab = d["model"]["vocab"] | added
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in added else bytes(chars[c] for c in token)
        if encodes:
            self.size_of = np.array([len(x) for x in self.bytes_of], np.int64)
            self.quick = self._quick(d)
            self.tok = None if self.quick else self._plain(definition)

    @staticmethod
    def _plain(definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(definition)
        tok.no_padding()
        tok.no_truncation()
        return tok

    def _quick(self, d: dict):
        """The same encoding by tiktoken, which is faster, where the file is a plain byte-level BPE of that kind: the
        usual splitting pattern, merges in the order of their ids, no normaliser."""
        import tiktoken

        model, pre = d["model"], d.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
        ids = [model["vocab"].get(a + b) for a, b in merges]
        usual = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        odd = d.get("normalizer") or model.get("dropout") or model.get("unk_token") or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in d.get("added_tokens", []))
        if not usual or odd or None in ids or ids != sorted(ids) or len(ids) + 256 != len(model["vocab"]) - sum(x["content"] in model["vocab"] for x in d.get("added_tokens", [])):
            return None
        special = {x["content"]: x["id"] for x in d.get("added_tokens", [])}
        ranks = {self.bytes_of[i]: i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("quick", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        if self.quick:
            return [np.array(self.quick.encode(x, allowed_special="all"), "<u4") for x in texts]
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, left: np.ndarray, right: np.ndarray, window: int = 32) -> np.ndarray:
        """The encoding of what ``left`` and ``right`` decode to, given that each is an encoding."""
        if not len(left) or not len(right):
            return left if len(left) else right
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            a, b = self.text(left[i:]), self.text(right[:j])
            if a is not None and b is not None:
                got = self.plain([a + b])[0]
                seam = int(self.size_of[left[i:]].sum())
                head = not i or self._agreed_head(left[i:], got, seam)
                tail = (len(got), j) if j == len(right) else self._agreed_tail(right[:j], got, seam)
                if head and tail:
                    return np.concatenate([left[:i], got[: tail[0]], right[tail[1] :]])
            window *= 2

    def text(self, ids: np.ndarray) -> str | None:
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()
        except UnicodeDecodeError:  # the window cuts a character
            return None

    def _agreed_head(self, own: np.ndarray, got: np.ndarray, seam: int) -> bool:
        return len(got) >= 2 and len(own) >= 2 and bool((own[:2] == got[:2]).all()) and int(self.size_of[own[:2]].sum()) + MARGIN <= seam

    def _agreed_tail(self, own: np.ndarray, got: np.ndarray, seam: int) -> tuple[int, int] | None:
        """Where two tokens in a row agree past the seam and MARGIN before the end: how many of ``got`` to take, and
        where ``own`` goes on."""
        ends_own, ends_got = seam + np.cumsum(self.size_of[own]), np.cumsum(self.size_of[got])
        common, x, y = np.intersect1d(ends_own[:-1], ends_got[:-1], return_indices=True)
        agree = (own[x] == got[y]) & (own[x + 1] == got[y + 1]) & (common > seam) & (ends_own[x + 1] + MARGIN <= ends_got[-1])
        return (int(y[agree][0]) + 1, int(x[agree][0]) + 1) if agree.any() else None

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        while len(parts) > 1:
            pairs = [self.joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
            parts = pairs
        return parts[0] if parts else np.array([], "<u4")

    def encode(self, texts: list[str | None], leaf: int = LEAF) -> list[bytes]:
        """Each whole text's ids; texts over ``leaf`` characters by tree concatenation. Null: empty."""
        texts = [x or "" for x in texts]
        cut = [[x[k : k + leaf] for k in range(0, len(x), leaf)] if len(x) > leaf else [x] for x in texts]
        flat = iter(self.plain([y for x in cut for y in x]))
        out = []
        for x in cut:
            own = [next(flat) for _ in x]
            out.append((own[0] if len(own) == 1 else self.tree(own)).astype("<u4").tobytes())
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


class Source:
    """A tokenizer file, read on the driver and sent to the workers once; its size is that of the vocabulary."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self.sent = spark.sparkContext.broadcast(f.read())

    def load(self, encodes: bool = True) -> ByteBpe:
        key = hash(self.sent.value), encodes
        if key not in _LOADED:
            _LOADED[key] = ByteBpe(self.sent.value, encodes)
        return _LOADED[key]


def batches(texts: list, most: int = 2 << 20) -> Iterator[slice]:
    """Slices of texts with about ``most`` characters each, so that memory does not follow the batch of rows."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, leaf: int = LEAF) -> DataFrame:
    """One row per input row: id and ``ids`` (little-endian 32-bit integers, binary).

    Texts up to ``segment`` characters are encoded where they are read, without a shuffle. Longer ones are cut into
    segments that are encoded as rows of their own, in parallel, and joined by text. Null text: empty, no ids. Special
    tokens written out in a text are encoded as such, as the library does by default. Repeated rows give repeated
    results (long texts need not have distinct ids). Other columns are ignored. Empty table: empty result.
    """
    source, id_type = Source(docs.sparkSession, path), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = source.load()
        for x in parts:
            ids, texts = x["id"], x["text"].tolist()
            for s in batches(texts):
                yield pd.DataFrame({"id": ids.iloc[s], "ids": bpe.encode(texts[s], leaf)})

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            for i, text in zip(x["id"], x["text"]):
                row = hashlib.blake2b(f"{i}\0{text}".encode(), digest_size=16).hexdigest()
                for k in range(0, len(text), segment):
                    yield pd.DataFrame({"row": [row], "id": [i], "k": [k], "text": [text[k : k + segment]]})

    def encode_segments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = source.load()
        for x in parts:
            yield pd.DataFrame({"row": x["row"], "id": x["id"], "k": x["k"], "ids": bpe.encode(x["text"].tolist(), leaf)})

    def join_text(x: pd.DataFrame) -> pd.DataFrame:
        bpe, x = source.load(), x.sort_values("k", kind="stable")
        copies = int((x["k"] == 0).sum())
        own = [np.frombuffer(y, "<u4") for y in x["ids"].iloc[::copies]]
        return pd.DataFrame({"id": [x["id"].iloc[0]] * copies, "ids": [bpe.tree(own).astype("<u4").tobytes()] * copies})

    size, out = F.length(F.coalesce("text", F.lit(""))), "id string, ids binary"
    short = rows.filter(size <= segment).mapInPandas(whole, out)
    pieces = rows.filter(size > segment).mapInPandas(cut, "row string, id string, k long, text string")
    pieces = pieces.repartition("row", "k").mapInPandas(encode_segments, "row string, id string, k long, ids binary")
    long = pieces.groupBy("row").applyInPandas(join_text, out)
    return short.unionByName(long).select(F.col("id").cast(id_type).alias(id_col), "ids")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, ``ids`` and ``decoded``, their text, special tokens included; null ids: empty text."""
    source, id_type = Source(encoded.sparkSession, path), encoded.schema[id_col].dataType.simpleString()

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = source.load(encodes=False)
        for x in parts:
            rows = x["ids"].tolist()
            for s in batches(rows):
                yield x.iloc[s].assign(decoded=[bpe.decode(y or b"") for y in rows[s]])

    rows = encoded.select(F.col(id_col).cast("string").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(decode, "id string, ids binary, decoded string").select(F.col("id").cast(id_type).alias(id_col), "ids", "decoded")
