"""Session defaults and the shared scratch location.

Every job in the package runs on whatever session the caller hands in; the
helpers here only fill in settings that are still unset, so a cluster's own
configuration always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a job relies on. They are applied only where the session leaves them unset.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "leadforge") -> SparkSession:
    """Local session for tests and the bench; clusters pass their own session instead."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LEADFORGE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read here.
    When it is unset on a local master (tests) a scratch folder is created and
    recorded; on a cluster that would be a folder no executor shares, so it is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="leadforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job's output."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block leave no shuffle files: they go when a job ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, path: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """``df`` written to ``path`` or a fresh scratch folder and read from there."""
    path = path or scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_in_buckets(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """Written in ``buckets`` buckets of ``column``: grouped and joined by it without an exchange."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    with shuffles_freed(spark):
        df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
    return spark.table(table)


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """The path of a fresh scratch folder, which goes with what was written there at the end of this block."""
    path = scratch_path(spark, name)
    try:
        yield path
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_table(df: DataFrame, name: str, materialize: bool = True) -> Iterator[DataFrame]:
    """``df`` written for the time of this block, or ``df`` itself without ``materialize``."""
    if not materialize:
        yield df
        return
    with scratch_folder(df.sparkSession, name) as path:
        yield written(df, name, path)
