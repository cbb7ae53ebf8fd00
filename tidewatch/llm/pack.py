"""Best-fit packing of tokenised documents into fixed-length sequences.

Lengths are whole numbers up to the capacity, so the instance is a histogram with at most ``capacity`` entries however
many documents there are. Only that histogram comes to the driver. Martello-Toth dominance reduction fixes sets of
lengths that are provably as good as any other use of their longest member, best fit packs what remains, and both give
runs (length, ranks from..to, first bin, pieces a bin, offset). Executors then place every piece by its rank among the
pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.bpe import Source, batches
from tidewatch.llm.skew import fresh
from tidewatch.runtime import written

#: Salts of a length at least, and rows of all lengths for each further salt.
SALTS, SALT_ROWS = 64, 1_000_000


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32.

    A document is its ids and then ``end_id``; only documents over ``capacity`` are cut, into pieces of ``capacity``;
    the first takes what is left over. Null and empty texts have the end id alone; very long ones are encoded whole, by
    tree concatenation. Repeated rows give repeated pieces. Other columns are ignored. Empty table: empty result."""
    source, id_type = Source(docs.sparkSession, path), docs.schema[id_col].dataType.simpleString()

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = source.load()
        for x in parts:
            ids, texts = x["id"].tolist(), x["text"].tolist()
            for s in batches(texts):
                rows = []
                for i, own in zip(ids[s], bpe.encode(texts[s])):
                    own += end_id.to_bytes(4, "little")
                    first = len(own) % (4 * capacity) or 4 * capacity
                    for piece, (at, end) in enumerate(zip([0, *range(first, len(own), 4 * capacity)], range(first, len(own) + 1, 4 * capacity))):
                        part = own[at:end]
                        rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(cut, "id string, piece int, start long, length long, ids_crc32 long")
    return out.select(F.col("id").cast(id_type).alias(id_col), "piece", "start", "length", "ids_crc32")


class Histogram:
    """Counts by length, and the longest single partner of a free space."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity = np.zeros(capacity + 1, np.int64), capacity
        for length, n in counts.items():
            self.left[length] = n

    def largest(self, most: int) -> int:
        found = np.flatnonzero(self.left[: most + 1])
        return int(found[-1]) if len(found) else 0

    def best_sum(self, room: int) -> int:
        """The largest sum of lengths still there, each as often as it is there, that fits ``room``."""
        reach, mask = 1, (1 << (room + 1)) - 1
        for length in np.flatnonzero(self.left[: room + 1]).tolist():
            n, k = min(int(self.left[length]), room // length), 1
            while n:
                k = min(k, n)
                reach |= (reach << (k * length)) & mask
                n, k = n - k, k * 2
            if reach >> room & 1:
                return room
        return reach.bit_length() - 1


def dominance(h: Histogram) -> list[tuple[list[int], int]]:
    """Sets of lengths, longest first, and how many bins of each are fixed for good; takes them out of ``h``.

    With a the longest piece and r the room beside it: alone if nothing fits; with b, the longest that fits, if no sum
    of what is left lies above b within r. Then whatever else could stand beside a could stand where b stood, so {a, b}
    dominates every other set with a."""
    fixed, a = [], h.capacity
    while a := h.largest(a):
        n, room = int(h.left[a]), h.capacity - a
        h.left[a] -= 1  # the piece itself does not count as its partner
        b = h.largest(room)
        exact = b == room or b and h.best_sum(room) == b
        h.left[a] += 1
        if not b or not room:
            fixed.append(([a], n))
            h.left[a] = 0
        elif exact:
            pairs = n // 2 if a == b else min(n, int(h.left[b]))
            fixed.append(([a, b], pairs))
            h.left[a] -= pairs
            h.left[b] -= pairs
        else:
            a -= 1  # not reducible: best fit takes it
    return fixed


def best_fit(h: Histogram) -> list[tuple[list[int], int]]:
    """Best fit by decreasing length of what is left; bins with equal contents stand as one entry with their number."""
    room_of: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(h.capacity, 0, -1):
        n = int(h.left[length])
        for room in [r for r in sorted(room_of) if r >= length]:
            kept = []
            for have, bins in room_of.pop(room):
                each = room // length
                full = min(bins, n // each)
                rest = min(n - full * each, each - 1) if full < bins else 0
                for k, m in ((each, full), (rest, 1 if rest else 0)):
                    if m:
                        room_of.setdefault(room - k * length, []).append((have + (length,) * k, m))
                        n -= k * m
                if bins - full - bool(rest):
                    kept.append((have, bins - full - bool(rest)))
            if kept:
                room_of.setdefault(room, [])[:0] = kept
            if not n:
                break
        if n:
            each = h.capacity // length
            full, rest = divmod(n, each)
            for k, m in ((each, full), (rest, 1 if rest else 0)):
                if m:
                    room_of.setdefault(h.capacity - k * length, []).append(((length,) * k, m))
    return [(list(have), bins) for entries in room_of.values() for have, bins in entries]


def plan_bins(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Runs of pieces: length, first rank, first bin, pieces a bin, offset of the first of them. Ordered by length, rank."""
    h = Histogram(counts, capacity)
    sets = dominance(h)
    sets += best_fit(h)
    rows, used, bin_ = [], dict.fromkeys(counts, 0), 0
    for lengths, bins in sets:
        at = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            rows.append((length, used[length], bin_, each, at))
            used[length] += each * bins
            at += each * length
        bin_ += bins
    assert used == counts, "every piece has a place"
    return pd.DataFrame(rows, columns=["length", "rank", "bin", "each", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Needs columns id, piece and length (1 to ``capacity``).

    Ranks within a length are made in two steps, inside (length, salt) and from the sums of the salts before, so a
    length with most of the pieces is spread over tasks, more of them the more pieces there are. Ties of (id, piece) and
    repeated rows are all placed, in any order; null ids too. Columns of the input whose names the result needs give way,
    all others stay. ``pieces`` should be a written table, as it is read three times. An empty table gives an empty
    table."""
    salt, n, rank, start, at = (fresh(x, pieces.columns) for x in ("salt", "n", "rank", "start", "at"))
    pieces = pieces.drop("sequence_id", "offset")
    salts = max(SALTS, pieces.count() // SALT_ROWS)
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(F.col(id_col), F.col("piece")), F.lit(salts)))
    sums = written(salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias(n)), "pack-counts")
    counts = {r["length"]: r["total"] for r in sums.groupBy("length").agg(F.sum(n).alias("total")).collect()}  # at most ``capacity`` rows
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths go from 1 to {capacity}")
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", salt, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inner = Window.partitionBy("length", salt).orderBy(id_col, "piece")
    ranked = salted.withColumn(rank, F.row_number().over(inner) - 1).join(starts, ["length", salt])
    ranked = ranked.withColumn(rank, (F.col(rank) + F.col(start)).cast("long"))
    plan = plan_bins(counts, capacity)
    table = pieces.sparkSession.sparkContext.broadcast({k: plan[k].to_numpy(np.int64) for k in plan})

    @F.pandas_udf("sequence_id long, offset long")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t = table.value
        order = t["length"] * (1 << 48) + t["rank"]
        for length, rank in parts:
            length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
            k = np.searchsorted(order, length * (1 << 48) + rank, "right") - 1
            bins, inside = np.divmod(rank - t["rank"][k], t["each"][k])
            yield pd.DataFrame({"sequence_id": t["bin"][k] + bins, "offset": t["offset"][k] + inside * length})

    placed = ranked.withColumn(at, place(F.col("length"), F.col(rank)))
    return placed.select(*pieces.columns, f"{at}.sequence_id", f"{at}.offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and its place there. Other columns are ignored."""
    return pack(written(token_pieces(docs, path, id_col, text_col, capacity, end_id), "pack-pieces"), id_col, capacity)
