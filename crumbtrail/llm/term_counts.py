"""Counts of every term, kept up to date by signed changes.

A record that is added, changed or deleted is turned into signed counts per term: plus its new
terms, minus its old ones. Only these are aggregated; the sums are merged into the stored counts,
which lie partitioned by a hash of the term. A merge reads and rewrites only the partitions that a changed
term falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.functions.text import normalize
from crumbtrail.session import stage

EMPTY = "array<string>"


def terms_of(tags: Column) -> Column:
    """The normalised terms of an array, null and blank ones dropped, repeats kept."""
    return F.filter(F.transform(F.coalesce(tags, F.array().cast(EMPTY)), normalize), lambda t: t.isNotNull() & (t != ""))


def signed_changes(old: DataFrame | None, new: DataFrame, record_id: str, tags: str) -> DataFrame:
    """term, occurrences, records: what ``new`` changes against the stored versions ``old``.

    ``new`` has the added and changed records, and deleted ones with ``_deleted`` true; a record
    that it repeats counts once. ``old`` holds the versions counted so far (None: nothing yet).
    A record with a null id is left out.
    """
    gone = F.col("_deleted") if "_deleted" in new.columns else F.lit(False)
    fresh = new.where(F.col(record_id).isNotNull()).select(F.col(record_id).alias("_id"), terms_of(F.col(tags)).alias("_new"), gone.alias("_gone")).dropDuplicates(["_id"])
    if old is None:
        both = fresh.where(~F.col("_gone")).withColumn("_old", F.array().cast(EMPTY))
    else:
        stored = old.where(F.col(record_id).isNotNull()).select(F.col(record_id).alias("_id"), terms_of(F.col(tags)).alias("_old")).dropDuplicates(["_id"])
        both = fresh.join(stored, "_id", "left").select(
            F.coalesce("_old", F.array().cast(EMPTY)).alias("_old"), F.when(F.col("_gone"), F.array().cast(EMPTY)).otherwise(F.col("_new")).alias("_new")
        )
    sign = F.array(F.struct(F.lit(1).alias("s"), F.col("_new").alias("t")), F.struct(F.lit(-1).alias("s"), F.col("_old").alias("t")))
    sides = both.select(F.explode(sign).alias("x")).where(F.size("x.t") > 0)
    firsts = F.transform("x.t", lambda t, k: F.struct(t.alias("term"), (F.array_position(F.col("x.t"), t) == k + 1).cast("int").alias("first")))
    long = sides.select("x.s", F.explode(firsts).alias("t")).select(F.col("t.term").alias("term"), "s", (F.col("s") * F.col("t.first")).alias("r"))
    return long.groupBy("term").agg(F.sum("s").alias("occurrences"), F.sum("r").alias("records")).where("occurrences != 0 OR records != 0")


def merge_counts(spark: SparkSession, path: str, changes: DataFrame, delivery: int, buckets: int = 32) -> None:
    """Adds the changes of a delivery to the counts stored at ``path``, which is made if it isn't there.

    Deliveries are numbered upwards. A partition holds the number of the last one that it took, and takes none twice and
    no older one, so that a delivery may be merged again, also after a merge that broke off between partitions. A term that falls to
    nothing stays with 0, so that its partition is rewritten. The merged partitions are written
    aside before they take their places. ``buckets`` is the number of partitions, the same for each merge: as many as
    make a partition of terms some 100 MB.
    """
    changes = stage(changes.select("term", "occurrences", "records").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")), "changes")
    touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    if there and not touched:
        return
    both = changes
    if there:
        stored = _stored(spark, path).where(F.col("bucket").isin(touched))
        done = {r["bucket"] for r in stored.groupBy("bucket").agg(F.max("delivery").alias("last")).where(F.col("last") >= delivery).collect()}  # at most ``buckets`` numbers
        if not set(touched) - done:
            return
        both = changes.unionByName(stored.drop("delivery")).where(~F.col("bucket").isin(sorted(done)))
    merged = both.groupBy("bucket", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    merged = stage(merged.withColumn("delivery", F.lit(delivery).cast("long")), "merged")
    merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, occurrences long, records long, delivery long, bucket int").parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """term, occurrences, records of all terms that any record holds."""
    return _stored(spark, path).where("records > 0").select("term", "occurrences", "records")


def marked(counts: DataFrame, n_records: DataFrame, least: int = 3, most_share: float = 0.1) -> DataFrame:
    """counts with ``mark``: ``rare`` under ``least`` records, ``common`` over ``most_share`` of all.

    ``n_records`` is one row, one column. A term that would be both is ``rare``.
    """
    total = n_records.toDF("_n")
    mark = F.when(F.col("records") < least, "rare").when(F.col("records") > F.lit(most_share) * F.col("_n"), "common")
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("_n")
