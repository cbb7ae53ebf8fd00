"""Where jobs put intermediate tables, and when a table is small enough to broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_PASSING: list[list[tuple[SparkSession, str]]] = []
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, one process may use a temporary folder of its
    own, which goes with it; a cluster may not, as its executors would each write to a disk of theirs."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-tidewatch-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the scratch folder and read it back: cuts lineage and survives lost executors. What a
    result still reads stays there; :func:`forget` removes what nothing reads any more. ``codec``: the session's if None."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for made in _PASSING[-1:]:
        made.append((df.sparkSession, path))
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """For work that ends inside the block: tables of :func:`written` that it made go at its end, and files of a shuffle with
    the job that made them, which else wait until the driver collects garbage. ``spark`` is a session of that work alone."""
    spark.conf.set(CLEAN_SHUFFLES, "true")
    _PASSING.append([])
    try:
        yield
    finally:
        for session, path in _PASSING.pop():
            remove(session, path)


def again(table: DataFrame) -> DataFrame:
    """A table of :func:`written` with columns of its own, for the other side of a cogroup with itself, where columns that
    both sides share would be pruned from one."""
    return table.sparkSession.read.schema(table.schema).parquet(_PATHS[table])


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def forget(*tables: DataFrame | None) -> None:
    """Remove tables that :func:`written` made and that no later table reads: all that came from them was written itself."""
    for df in tables:
        if df is not None and (path := _PATHS.pop(df, None)):
            remove(df.sparkSession, path)


def small(df: DataFrame, row_bytes: int, limit_bytes: int) -> bool:
    """Whether ``df`` (cheap to count: a written table) stays under ``limit_bytes`` at ``row_bytes`` a row."""
    return df.limit(limit_bytes // row_bytes + 1).count() * row_bytes <= limit_bytes


def maybe_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its size is under the limit, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if small(df, row_bytes, limit_bytes) else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as shuffles have, by ``keys``: for small sides of a join that makes many rows, which adaptive
    execution would put into a few tasks by their own size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches bounded by bytes where the session has the default of 64 MB: workers hold a batch of whole texts
    several times over, as Arrow, as Python strings and as the result."""
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "64m", "64MB"):
        spark.conf.set(BATCH_BYTES, "4m")
    return spark


def shipped(spark: SparkSession) -> SparkSession:
    """Make this package importable on the workers, where neither PYTHONPATH nor the working folder does so."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    reachable = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.realpath(os.getcwd()) == os.path.realpath(root)
    if not reachable and app not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="spark-tidewatch-code-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tidewatch", "zip", root, "tidewatch"))
        _SHIPPED.add(app)
    return spark
