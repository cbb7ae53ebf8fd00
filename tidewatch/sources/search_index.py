"""A stored index for substring search: runs of characters by bucket, their counts, and the texts, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatch.functions.search import confirmed, postings, rarest, word_runs
from tidewatch.runtime import forget, maybe_broadcast, written


def index_batch(rows: DataFrame, folder: str, batch: str, buckets: int = 64) -> None:
    """Index ``rows`` (``id``, unique in the batch, and ``text``; other columns stay with the text) as ``batch`` under
    ``folder``. A batch replaces what stands under its name, so a repeated one changes nothing and one that stopped half
    way is put right by repeating it; other batches are not touched. ``buckets`` is the index's for good. Null and empty
    texts are kept and never found."""
    spark = rows.sparkSession
    put = lambda df, table, *by: df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{table}/batch={batch}")
    put(rows, "texts")
    texts = spark.read.schema(rows.schema).parquet(f"{folder}/texts/batch={batch}")
    listed = postings(texts, "text", "id").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    put(listed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(shares))).sortWithinPartitions("bucket", "gram"), "grams", "bucket")
    stored = spark.read.schema(listed.schema).parquet(f"{folder}/grams/batch={batch}")
    put(stored.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n")), "counts", "bucket")


def look_up(spark: SparkSession, folder: str, words: DataFrame, batches: list[str] | None = None) -> DataFrame:
    """Each indexed text with each row of ``words`` (``k``, not empty, and more) whose ``k`` it contains: the columns of
    the texts, ``batch``, and those of ``words``. Reads the counts of the words' runs, then only the buckets of their
    rarest ones, and only ``batches`` if given. An id that two batches have is two texts."""

    def table(name: str) -> DataFrame:
        path = f"{folder}/{name}"
        kinds = [StructField("batch", StringType()) if f.name == "batch" else f for f in spark.read.parquet(path).schema]
        df = spark.read.schema(StructType(kinds)).parquet(path)  # a batch is a name, also where it looks like a number
        return df if batches is None else df.filter(F.col("batch").isin(batches))

    words = words.filter("k is not null and k <> ''")
    runs = written(word_runs(words), "search-runs")
    needed = maybe_broadcast(runs.select("gram").distinct(), 40)
    counts = table("counts").join(needed, "gram", "left_semi").groupBy("gram", "bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "search-counts")
    keys = written(rarest(runs, counts.select("gram", "n")), "search-keys")
    touched = [r[0] for r in keys.join(counts, "gram").select("bucket").distinct().collect()]  # as many as buckets at most
    listed = table("grams").filter(F.col("bucket").isin(touched)).join(maybe_broadcast(keys.select("gram").distinct(), 40), "gram", "left_semi")
    forget(runs, counts)
    texts = table("texts")
    found = confirmed(texts, "text", listed, keys, "batch", "id")
    return found.join(words, "k").select(*texts.columns, *words.columns)
