"""Parquet tables and the adapters that give each row id once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per id. Rows delivered twice are equal in every column, so any of them serves.

    Select the needed columns first: only those are shuffled.
    """
    return df.dropDuplicates([key])


def businesses(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "businesses"))


def reviews(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    df = table(spark, folder, "reviews")
    return once(df.select("id", *columns) if columns else df)


def dishes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Dishes with null counts read as 0 and null tags as none."""
    df = table(spark, folder, "dishes")
    df = once(df.select("id", *columns) if columns else df)
    counts = [c for c in ("mention_count", "positive_count", "negative_count") if c in df.columns]
    df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return df.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))) if "tags" in df.columns else df


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Valid mentions: id, review_id, business_id, dish_name, sentiment, tags.

    A mention needs a business, a name that isn't blank and one of the three sentiments, as the
    table's constraints demand. Null tags are none; a null tag in an array is dropped.
    """
    from crumbtrail.functions.text import normalize

    df = once(table(spark, folder, "dish_extractions"))
    df = df.where(F.col("business_id").isNotNull() & F.col("sentiment").isin("positive", "negative", "neutral") & (normalize(F.col("dish_name")) != ""))
    return df.withColumn("tags", F.array_compact(F.coalesce("tags", F.array().cast("array<string>"))))
