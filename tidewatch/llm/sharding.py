"""Shards of near equal bytes: longest processing time first, over groups of rows that must stay together.

Groups, largest first, go to the least loaded shard through a heap. Sizes are told apart to one part in 8192 (exactly up
to 8192 bytes), so the groups are a histogram of some hundred thousand classes at most however many there are. Only that
histogram comes to the driver; a class's groups go to the shards in one step that gives each what one push a group would.
Executors then find each group's shard by its rank in its class.
"""

from __future__ import annotations

import heapq
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.skew import fresh, spread_join
from tidewatch.runtime import forget, maybe_broadcast, written

#: Bits of a size that tell classes apart.
BITS = 13
#: Salts of a rank at least, and rows for each further salt; bytes of a row of groups, and of the plan's for each shard.
SALTS, SALT_ROWS, GROUP_BYTES, RUN_BYTES = 64, 1_000_000, 64, 16


def size_class(size: Column) -> Column:
    """The size with all but its first BITS bits cleared: at most ``2 ** (BITS - 1)`` values between powers of two."""
    low = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size.cast("double"))) - (BITS - 1), F.lit(0))).cast("long")
    return size - F.pmod(size, low)


def shares(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` items of one size each load gets if each item goes to the least load (ties: the first)."""
    low, high = min(loads), max(loads) + size * (n + 1)
    count = lambda level: sum(-(-(level - x) // size) for x in loads if x < level)  # noqa: E731  items that start below it
    while low < high:
        level = (low + high + 1) // 2
        low, high = (level, high) if count(level) <= n else (low, level - 1)
    out = [max(0, -(-(low - x) // size)) for x in loads]
    heap = [(x + k * size, i) for i, (x, k) in enumerate(zip(loads, out))]
    heapq.heapify(heap)
    for _ in range(n - sum(out)):
        at, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (at + size, i))
    return out


def longest_first(classes: list[tuple[int, int, int]], shards: int) -> pa.Table:
    """For each class (key, groups, bytes of all), largest groups first: at which ranks runs of its groups start, and to
    which shard each run goes, ``shards`` runs at most.

    Single groups go through the heap one by one; a class of more groups counts by their mean size."""
    heap = [(0, i) for i in range(shards)]
    keys, bounds, starts, to = array("q"), array("i", [0]), array("q"), array("i")
    for key, n, total in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        keys.append(key)
        if n == 1:
            load, i = heapq.heappop(heap)
            heapq.heappush(heap, (load + total, i))
            starts.append(0)
            to.append(i)
        else:
            have = [x for _, x in sorted((i, x) for x, i in heap)]
            each, at = shares([x * n for x in have], total, n), 0  # scaled by n, the mean size is a whole number
            for i, k in enumerate(each):
                if k:
                    starts.append(at)
                    to.append(i)
                    at += k
            heap = [(x + k * total // n, i) for i, (x, k) in enumerate(zip(have, each))]
            heapq.heapify(heap)
        bounds.append(len(to))
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
    return pa.table({"class": pa.array(keys, pa.int64()), "starts": lists(starts, pa.int64()), "to": lists(to, pa.int32())})


def numbered(rows: DataFrame, by: str, key: str, n: int, out: str) -> DataFrame:
    """``rows`` (a written table of ``n`` rows, ``key`` unique) with ``out``: 0, 1, ... within ``by``, without a gap.

    Rows are ranked inside (by, salt) and start from the sums of the salts before, so a ``by`` with most of the rows is
    spread over tasks, more of them the more rows there are."""
    salt, count, start = (fresh(x, [*rows.columns, out]) for x in ("salt", "count", "start"))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(max(SALTS, n // SALT_ROWS))))
    sums = written(salted.groupBy(by, salt).agg(F.count(F.lit(1)).alias(count)), "shard-counts")
    before = Window.partitionBy(by).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(by, salt, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    inner = Window.partitionBy(by, salt).orderBy(key)
    ranked = salted.withColumn(out, F.row_number().over(inner) - 1).join(starts, [by, salt])
    return ranked.withColumn(out, (F.col(out) + F.col(start)).cast("long")).drop(salt, start)


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", together: Column | None = None) -> DataFrame:
    """One row per input row: id, ``size`` (UTF-8 bytes of the text and 8), ``text_crc32``, ``shard`` (0 to shards - 1)
    and ``slot`` (0, 1, ... within the shard, without a gap).

    Rows with equal ``together`` (of any type; nulls are equal; without it, rows of equal text) share a shard. Shards come
    out as near as whole groups allow: no group larger than a shard's share is ever split, and sizes of one class differ
    by one part in 8192. A null text has no bytes and counts as an empty one; very long texts are read once, where they
    are; ties and repeated rows, also with null ids, are all placed, each with a slot of its own. A group of any number of
    rows is pre-aggregated and its rows find its shard by :func:`spread_join`. Other columns are ignored whatever their
    names. An empty table gives an empty table."""
    if shards < 1:
        raise ValueError("one shard or more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(text if together is None else F.to_json(F.struct(together.alias("k"))), 256))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")

    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    groups = written(groups.withColumn("class", size_class(F.col("bytes"))), "shard-groups")
    found = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).toArrow().to_pydict()
    n_groups, n_rows = sum(found["n"]), sum(found["rows"])
    plan = docs.sparkSession.createDataFrame(longest_first(list(zip(found["class"], found["n"], found["bytes"])), shards))
    plan = written(plan, "shard-plan")
    ranked = numbered(groups, "class", "key", n_groups, "rank").join(maybe_broadcast(plan, 64 + RUN_BYTES * shards), "class")
    upto = F.size(F.filter("starts", lambda s: s <= F.col("rank")))
    placed = written(ranked.select("key", "rows", F.element_at("to", upto).alias("shard")), "shard-placed")
    forget(groups, plan)

    dealt = spread_join(rows, placed, ["key"], "rows", n_rows, GROUP_BYTES).select("id", "size", "crc", "row", "shard")
    dealt = written(dealt, "shard-dealt")
    forget(rows, placed)
    out = numbered(dealt, "shard", "row", n_rows, "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, id_col: str = "doc_id", rows_a_file: int = 1_000_000) -> None:
    """Write ``docs`` (unique ids) under ``path``, a folder a shard, rows by slot; files of ``rows_a_file`` at most.

    Rows are dealt by (shard, range of slots), so a shard is written by as many tasks as it has files."""
    clash = [c for c in docs.columns if c.lower() in ("shard", "slot", "file_")]
    if clash:
        raise ValueError(f"columns {clash} stand for the place in a shard")
    rows = docs.join(sharded.select(id_col, "shard", "slot"), id_col).withColumn("file_", F.floor(F.col("slot") / rows_a_file))
    parts = max(1, sharded.select("shard", F.floor(F.col("slot") / rows_a_file)).distinct().count())
    rows.repartition(parts, "shard", "file_").drop("file_").sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)
