"""Extraction as a stream: each review once, failures tried again with the next run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crumbtrail.providers import extract, lexicon_extractor, mention_rows
from crumbtrail.schemas import MENTIONS

REVIEW = T.StructType([T.StructField("id", T.LongType()), T.StructField("business_id", T.LongType()), T.StructField("review_text", T.StringType())])
RESULT = f"review_id long, business_id long, mentions {MENTIONS.simpleString()}, error string, extracted_at timestamp, batch string"


def _results(spark: SparkSession, out: str) -> DataFrame:
    """All attempts, one row per review and batch; none before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/results")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(f"{out}/results")


def read_mentions(spark: SparkSession, out: str) -> DataFrame:
    """The mentions of all finished reviews."""
    return mention_rows(_results(spark, out))


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """review_id, extracted_at of the finished reviews, whether or not anything was found in them."""
    return _results(spark, out).where("error IS NULL").groupBy("review_id").agg(F.min("extracted_at").alias("extracted_at"))


def _extract_into(todo: DataFrame, out: str, batch: str, extractor: Callable, **how) -> None:
    """One written table holds mentions, stamps and errors of a batch, so that they agree whatever is lost on the way."""
    found = extract(todo.dropDuplicates(["id"]), extractor, **how).withColumn("extracted_at", F.current_timestamp())
    found.write.mode("overwrite").parquet(f"{out}/results/batch={batch}")


def retry_failed(spark: SparkSession, reviews: str, out: str, extractor: Callable = lexicon_extractor, schema: T.StructType = REVIEW, **how) -> None:
    """Extracts again what an earlier batch tried and no batch has finished."""
    tried = _results(spark, out)
    open_ = tried.select("review_id").distinct().join(read_ledger(spark, out), "review_id", "left_anti").select(F.col("review_id").alias("id"))
    if not open_.isEmpty():
        todo = spark.read.schema(schema).parquet(reviews).join(open_, "id", "left_semi")
        _extract_into(todo, out, f"again-{uuid.uuid4().hex}", extractor, **how)


def start_extraction(spark: SparkSession, reviews: str, out: str, extractor: Callable = lexicon_extractor, schema: T.StructType = REVIEW, **how):
    """A stream of review files to the results in ``out``, read by ``read_mentions`` and ``read_ledger``.

    Reviews that failed in earlier runs are tried again first. A batch is written under its number, so one that is run again
    after a loss takes its own place. Reviews in the ledger are left out. ``how`` goes on to ``extract``.
    """
    retry_failed(spark, reviews, out, extractor, schema, **how)

    def batch(df: DataFrame, number: int) -> None:
        tried = _results(df.sparkSession, out).where(F.col("batch") != str(number))
        _extract_into(df.join(tried.where("error IS NULL").selectExpr("review_id AS id").distinct(), "id", "left_anti"), out, str(number), extractor, **how)

    stream = spark.readStream.schema(schema).parquet(reviews)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
