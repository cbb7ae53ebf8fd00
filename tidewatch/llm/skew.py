"""Joins in which a key may hold any share of the rows, and names that clash with nothing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import small

#: Keys with more than 1 in HOT of all rows, and more than LEAST, are hot: there are fewer than HOT of them.
HOT, LEAST = 100_000, 1000


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, row_bytes: int, limit_bytes: int = 32 << 20, hot: int = HOT, least: int = LEAST) -> DataFrame:
    """``rows`` left joined to ``groups`` (unique in ``on``; ``size``: rows of the key, of ``total``).

    ``groups``, a written table, is broadcast if it is small (counted). Else only its hot keys are, fewer than ``hot``
    of them whatever the data, and the rest is shuffled, where no key has more than ``total / hot`` rows (or ``least``).
    Both have names of their own beside ``on``; nulls in ``on`` find nothing."""
    if small(groups, row_bytes, limit_bytes):
        return rows.join(F.broadcast(groups), on, "left")
    above, mark = max(least, total // hot), fresh("hot", [*rows.columns, *groups.columns])
    marked = rows.join(F.broadcast(groups.filter(F.col(size) > above).withColumn(mark, F.lit(True))), on, "left")
    rest = marked.filter(F.col(mark).isNull()).select(*rows.columns).join(groups.filter(F.col(size) <= above), on, "left")
    return marked.filter(F.col(mark)).drop(mark).unionByName(rest)


def salted_join(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int, spread: list[str], hot: int = HOT, least: int = LEAST) -> DataFrame:
    """``rows`` inner joined to ``groups`` (unique in ``on``, of any width; ``size``: rows of the key, of ``total``).

    A hot key's rows are dealt by a hash of ``spread`` over as many copies of its group as keep each under ``total / hot``
    rows (or ``least``). Only the hot keys' numbers are broadcast, fewer than ``hot`` of them whatever the data."""
    above = max(least, total // hot)
    salts, salt = fresh("salts", [*rows.columns, *groups.columns]), fresh("salt", [*rows.columns, *groups.columns])
    many = F.ceil(F.col(size) / above)
    split = groups.filter(F.col(size) > above).select(on, many.alias(salts))
    dealt = rows.join(F.broadcast(split), on, "left").withColumn(salt, F.pmod(F.xxhash64(*spread), F.coalesce(salts, F.lit(1).cast("long")))).drop(salts)
    copies = groups.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    return dealt.join(copies, [on, salt]).drop(salt)
