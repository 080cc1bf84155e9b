"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("crumbtrail")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session has none and all of Spark runs on this machine (tests, a laptop), one is made and set; on a
    cluster that is an error, as executors would not see each other's files.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = spark.sparkContext.getCheckpointDir()
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not given:
        given = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(given)
    return given


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM exits."""
    path = f"{shared_dir(spark)}/crumbtrail/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str, partition_by: str | None = None, group_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage, keeps the rows through the loss of any executor, and lets later
    reads prune columns and partitions. The shuffle files of this job are removed with its end, as nothing reads them
    again; else they stay until the driver collects its garbage. Spark decodes thousands of rows at a time, but never beyond a row group: a table
    whose rows are large needs ``group_rows``, the rows of a row group at most.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
