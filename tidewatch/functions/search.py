"""Which texts contain which words, by runs of characters: a word is looked up by the rarest of its runs and confirmed.

Runs have three characters; a word of fewer is one run, and texts list those too. A text that contains a word has all of
the word's runs, so the texts listed under any one of them hold all hits, and the rarest leaves the fewest to confirm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import maybe_broadcast, small

RUN = 3
#: Texts under one run that one task confirms; a longer list is split by text.
SHARE = 100_000
#: Bytes of keys, at 80 each, up to which every task has them all.
KEYS = 64 << 20


def _runs(text: Column, n: Column | int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))


def text_runs(text: str) -> Column:
    """The distinct runs of one to three characters of a text; none of null or empty ones."""
    sizes = F.array(*[F.lit(n) for n in range(1, RUN + 1)])
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(text)), lambda n: _runs(F.col(text), n))))


def postings(rows: DataFrame, text: str, *ids: str) -> DataFrame:
    """A row for each text and distinct run of it: ``ids`` and ``gram``."""
    return rows.select(*ids, F.explode(text_runs(text)).alias("gram"))


def word_runs(words: DataFrame) -> DataFrame:
    """``k`` and ``gram``: the distinct runs that each distinct word ``k`` (not empty) must have in a text."""
    k = F.col("k")
    every = F.when(F.length(k) > RUN, F.array_distinct(_runs(k, RUN))).otherwise(F.array(k))
    return words.select("k").distinct().select("k", F.explode(every).alias("gram"))


def rarest(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``k``, ``gram`` and ``n``: each word's run with the fewest texts (ties: the first run), by ``counts`` (gram, n). A
    word with a run that no text has is in no text and left out."""
    n = runs.join(counts, "gram", "left").select("k", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    best = n.groupBy("k").agg(F.min(F.struct("n", "gram")).alias("b"))
    return best.select("k", F.col("b.gram").alias("gram"), F.col("b.n").alias("n")).filter("n > 0")


def candidates(listed: DataFrame, keys: DataFrame, *ids: str) -> DataFrame:
    """``ids`` of the texts of ``listed`` (postings) under each word's run of ``keys`` (:func:`rarest`, written), with
    ``k``. Runs with more texts than ``SHARE`` are split by text, so that no task takes a whole common one."""
    parts = (F.floor(F.col("n") / SHARE) + 1).cast("int")
    hot = keys.filter(F.col("n") >= SHARE).select("gram", parts.alias("_parts")).distinct()
    spread = listed.join(maybe_broadcast(hot, 40), "gram", "left")
    spread = spread.withColumn("_part", F.pmod(F.xxhash64(*ids), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    dealt = keys.select("k", "gram", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return spread.join(dealt, ["gram", "_part"]).select(*ids, "k")


def confirmed(texts: DataFrame, text: str, listed: DataFrame, keys: DataFrame, *ids: str) -> DataFrame:
    """Rows of ``texts`` (``ids`` and more) with each word ``k`` of ``keys`` (:func:`rarest`, written) that ``text``
    contains. A text meets the runs it is listed under once, and in its task the words of those runs, of which only those
    it contains leave: words times texts of a common run are never written or shuffled. Keys that are too many to go to
    every task meet the lists by run (:func:`candidates`)."""
    contains = F.col(text).contains(F.col("k"))
    if not small(keys, 80, KEYS):
        return texts.join(candidates(listed, keys, *ids), [*ids]).filter(contains)
    runs = listed.groupBy(*ids).agg(F.collect_list("gram").alias("_grams"))
    each = texts.join(runs, [*ids]).withColumn("_gram", F.explode("_grams")).drop("_grams")
    return each.join(F.broadcast(keys.select(F.col("gram").alias("_gram"), "k")), "_gram").filter(contains).drop("_gram")
