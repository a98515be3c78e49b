"""Session helpers: runtime settings, the shared work folder, bounded reads."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when that costs a later re-shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()
_LOCAL_WORK: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Python workers import it to run the batch functions; they do not share the
    driver's import path.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "folioscope")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
        _SHIPPED.add(app)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs rely on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "folioscope") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def work_dir(spark: SparkSession) -> str:
    """A fresh folder on storage every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder: executors of a cluster could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_WORK:
            _LOCAL_WORK[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _LOCAL_WORK[app]
    return f"{base.rstrip('/')}/folioscope-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps then start from stored rows, so slow or non-repeatable work
    (inference) is never run again by a retry or a second consumer.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written in this block are of no use from then on, and go with the write."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def dropped(stored: DataFrame) -> None:
    """Remove what ``written`` wrote, once no later step reads it."""
    jvm, spark = stored.sparkSession._jvm, stored.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_rows(df: DataFrame, bound: int) -> list | None:
    """The rows of ``df`` when there are at most ``bound``, else ``None``."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Mark a table of short rows for broadcast once it is known to be small.

    ``df`` should be stored: it is counted, up to ``rows``.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than the session has.

    Small inputs arrive as one row group; large ones already have more splits
    than cores and are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
