"""Writing tables, and rows as text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.functions.text import counted, tags_text


def overwrite_partitions(df: DataFrame, path: str, key: str = "business_id") -> None:
    """Replaces the key's partitions that ``df`` has, and leaves all others. A large partition is written by several tasks."""
    df.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _rename(files, source, target) -> None:
    """Hadoop tells of a rename that failed by what it returns."""
    if not files.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def swap(df: DataFrame, path: str) -> None:
    """``df``, which may read ``path``, takes its place: written beside it, then renamed.

    The old table is deleted last; if the new one can't take its place, the old one is put back and the error goes on.
    """
    spark: SparkSession = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(new)
    here = jvm.org.apache.hadoop.fs.Path(path)
    files = here.getFileSystem(conf)
    before, after = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    held = files.exists(here)
    if held:
        _rename(files, here, before)
    try:
        _rename(files, after, here)
    except Exception:
        if held:
            _rename(files, before, here)
        raise
    files.delete(before, True)
    spark.catalog.refreshByPath(path)


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode("error").parquet(target)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, in ``value``, null fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def listing_line(name: Column, mentions: Column, positive: Column, negative: Column, tags: Column) -> Column:
    return F.concat(name, F.lit(": "), mentions.cast("string"), F.lit(" mention(s) ("), positive.cast("string"), F.lit(" positive, "), negative.cast("string"), F.lit(" negative) — tags: "), tags_text(tags, "—"))


def ranked_line(rank: Column, name: Column, positive: Column, negative: Column, mentions: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit(". "), name, F.lit("  ("), positive.cast("string"), F.lit("/"), (positive + negative).cast("string"), F.lit(" positive, "), counted(mentions, "mention"), F.lit(")"))
