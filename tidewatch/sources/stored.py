"""Tables kept in partitions: only the partitions that a change touches are read and written again, and a repeated change
leaves what the first one did. A change that stopped half way is put right by repeating it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.behavior import archive_split
from tidewatch.runtime import exists, forget, remove, written
from tidewatch.sources.tables import ago, assign_groups, upsert_trends


def put_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of ``path`` that ``rows`` has, by its column ``by``; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _values(rows: DataFrame, by: str) -> list:
    """The partitions of ``rows``: as many as days or buckets at most, never as rows."""
    return [r[0] for r in rows.select(by).filter(F.col(by).isNotNull()).distinct().collect()]


def _replaced(rows: DataFrame, path: str, by: str, label: str) -> None:
    """Write ``rows``, which read ``path``, aside first, then over their partitions."""
    out = written(rows, label)
    put_partitions(out, path, by)
    forget(out)


def upsert_stored(incoming: DataFrame, path: str, buckets: int = 64) -> None:
    """:func:`upsert_trends` into a table under ``path`` by buckets of the key (platform, keyword, locale); ``buckets`` is
    the table's for good. Null parts of a key are equal to each other; nothing incoming changes nothing."""
    key = F.pmod(F.xxhash64("platform", "keyword", "locale"), F.lit(buckets)).cast("int")
    new = incoming.withColumn("bucket", key)
    there = exists(incoming.sparkSession, path)
    touched = _values(new, "bucket") if there else []
    current = incoming.sparkSession.read.parquet(path).filter(F.col("bucket").isin(touched)) if there else new.limit(0)
    _replaced(upsert_trends(current, new), path, "bucket", "trends-upserted")


def touched_days(assignment: DataFrame, path: str, by: str = "publish_date") -> list:
    """Days of the stored articles that ``assignment`` (url_hash, group_id) names; reads two columns."""
    urls = assignment.select("url_hash").distinct()
    return _values(assignment.sparkSession.read.parquet(path).select("url_hash", by).join(urls, "url_hash", "left_semi"), by)


def assign_stored(assignment: DataFrame, path: str, by: str = "publish_date") -> None:
    """:func:`assign_groups` on articles stored under ``path`` by day. Days without a named article are not read whole and
    not written; articles without a day keep the group they have."""
    days = touched_days(assignment, path, by)
    if days:
        articles = assignment.sparkSession.read.parquet(path)
        rows = assign_groups(articles.filter(F.col(by).isin(days)), assignment).select(*articles.columns)
        _replaced(rows, path, by, "articles-assigned")


def archive_stored(spark: SparkSession, live: str, archive: str, as_of, days: int = 90, by: str = "created_date", key: str = "id") -> None:
    """Move the days that ended more than ``days`` before ``as_of`` from ``live`` to ``archive``, both by day. What came
    late for a day that is archived joins it there, by ``key``; rows without a time stay live."""
    columns = spark.read.parquet(live).columns
    whole = spark.read.parquet(live).filter(F.col(by) < F.to_date(ago(as_of, days * 86400)))
    old = archive_split(whole, as_of, days)[0].select(*columns)
    moved = _values(whole, by)
    if not moved:
        return
    if exists(spark, archive):
        kept = spark.read.parquet(archive).filter(F.col(by).isin(moved)).select(*columns)
        old = kept.join(old.select(key), key, "left_anti").select(*columns).unionByName(old)
    _replaced(old, archive, by, "archived")
    for day in moved:  # the copy is there: the live days go
        remove(spark, f"{live}/{by}={day}")
