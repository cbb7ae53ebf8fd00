"""Exact de-duplication by progressive refinement: length, then a prefix hash, then the full hash. Native only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.skew import fresh, spread_join
from tidewatch.runtime import forget, written

#: The white space that does not count when texts are compared.
WHITE = r"[\x20\x09-\x0D]+"
KEY_BYTES, GROUP_BYTES, BROADCAST = 64, 160, 64 << 20
#: Bits of one bitmap of Spark's, and bytes of the filter of surviving keys at most.
BITMAP, FILTER = 32768, 32 << 20


def normalised(text: str):
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def _places(keys: int, filter_bytes: int) -> str:
    """Where a key (n, pre) stands in a filter of so many bits: 16 a key, as far as ``filter_bytes`` go."""
    bits = BITMAP
    while bits < 16 * keys and bits < 8 * filter_bytes:
        bits *= 2
    return f"pmod(xxhash64(n, pre), {bits}L)"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, all_digests: bool = False, broadcast_limit: int = BROADCAST, filter_bytes: int = FILTER) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and ``digest`` of the normalised text.

    1. lengths of normalised texts that occur more than once; 2. among those, prefix hashes that occur more than once;
    3. a full SHA-256 only for rows whose (length, prefix) survives, and groups by it. Sizes, prefixes and digests are
    pre-aggregated before each shuffle, so a group of any size is a few rows, and what is known of a group goes back to
    its rows by :func:`spread_join`. The surviving keys go into the scan as a filter of 16 bits a key, ``filter_bytes`` at
    most, so that texts are not moved, and only rows that hit it (a sixteenth of the others, more where a full filter
    gets more keys) are hashed; whether a row's key survives is then settled exactly, on short rows.

    Of equal texts the longest original stays, then the smallest id, of any type that has an order; null ids sort last.
    Null text: empty, and all empty texts are one group. Very long texts are hashed whole where they are read. Rows that
    repeat an id and a text are copies of each other and each such row is ``kept`` if its id stays. ``digest`` is null
    for rows whose length and prefix no other row has, unless ``all_digests``. Other columns are ignored whatever their
    names. An empty table gives an empty table.
    """
    norm = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"), norm.alias("norm"))
    keyed = rows.select("id", F.length("raw").cast("long").alias("points"), F.length("norm").cast("long").alias("n"), F.xxhash64(F.substring("norm", 1, prefix)).alias("pre"), "norm")

    sizes = written(keyed.groupBy("n", "pre").agg(F.count(F.lit(1)).alias("rows")), "dedup-sizes")
    lengths = sizes.groupBy("n").agg(F.sum("rows").alias("of_length")).filter("of_length > 1").select("n")
    keys = written(sizes.join(lengths, "n", "left_semi").filter("rows > 1"), "dedup-keys")
    total = sizes.agg(F.sum("rows")).first()[0] or 0

    # the filter goes into the scan, which hashes what hits it; that the key itself survives is settled on short rows
    place = _places(keys.count(), filter_bytes)
    filters = keys.groupBy(F.expr(f"{place} div {BITMAP}").alias("bucket")).agg(F.bitmap_construct_agg(F.expr(f"{place} % {BITMAP}")).alias("bitmap"))
    filters = written(filters, "dedup-filters")
    hit = F.expr(f"shiftright(cast(conv(hex(substring(bitmap, cast({place} % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int), cast({place} % 8 as int)) & 1 = 1")
    scan = keyed.withColumn("bucket", F.expr(f"{place} div {BITMAP}")).join(F.broadcast(filters), "bucket", "left")  # filter_bytes at most
    full = F.sha2("norm", 256)
    short = scan.select("id", "points", "n", "pre", (full if all_digests else F.when(hit, full)).alias("full"))
    found = spread_join(written(short, "dedup-short"), keys, ["n", "pre"], "rows", total, KEY_BYTES, broadcast_limit)
    key = F.when(F.col("rows").isNotNull(), F.col("full"))
    hashed = written(found.select("id", "points", key.alias("key"), (F.col("full") if all_digests else key).alias("digest")), "dedup-hashed")

    forget(sizes, keys)

    best = F.min(F.struct((-F.col("points")).alias("neg"), F.col("id").isNull().alias("last"), "id")).alias("best")
    groups = hashed.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), best).filter("group_size > 1")
    groups = written(groups.select("key", "group_size", F.col("best.id").alias("best"), F.lit(True).alias("grouped")), "dedup-groups")
    out = spread_join(hashed, groups, ["key"], "group_size", total, GROUP_BYTES, broadcast_limit)
    keep = F.when(F.col("grouped"), F.col("best")).otherwise(F.col("id"))
    out = out.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_limit: int = BROADCAST) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` does not keep; all columns stay, whatever their names. Rows that
    share an id stay together if one of them does (ids are keys; null is one of them)."""
    stays = fresh("kept", docs.columns)
    kept = exact_dedup(docs, id_col, text_col, broadcast_limit=broadcast_limit).filter("kept").select(F.col(id_col).alias(stays)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(stays)), "left_semi")
