"""Session helpers: where intermediate tables live, and how they are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own; elsewhere a
    missing setting is an error, since a machine-local folder cannot be read by other executors.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gridloom-{label}-{uuid.uuid4().hex}"


def few(df: DataFrame, rows: int, per: int = 100_000) -> DataFrame:
    """``df`` in about one partition for ``per`` of its rows, if it has more; without a shuffle."""
    return df.coalesce(max(8, -(-rows // per)))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside give the disk of their shuffles back when they end, not when the driver
    happens to collect garbage. For queries whose result is written: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def store(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost
    executor costs a re-read, not a recomputation. ``rows``, if known, keeps small tables in few
    files."""
    spark = df.sparkSession
    path = new_path(spark, label)
    if rows is not None:
        df = few(df, rows)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._gridloom_path = path
    return back


def store_counted(df: DataFrame, label: str, rows: int | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`store`, and what it counted on the way: ``rows`` and further aggregates, without a job
    of their own."""
    watch = Observation(f"{label}-{uuid.uuid4().hex}")
    back = store(df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]), label, rows)
    return back, watch.get


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables made by :func:`store` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_gridloom_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
