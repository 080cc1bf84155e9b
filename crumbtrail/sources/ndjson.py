"""Newline-delimited JSON: strict scans, and raw lines that pass through unchanged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crumbtrail.functions.text import strip
from crumbtrail.schemas import BUSINESS_JSON, REQUIRED, REVIEW_JSON


def _checked(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows as they are; a null in a required key fails the job when it is read."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    # A filter, so that the check is made whatever columns are read.
    return df.where(F.when(missing, F.raise_error(F.lit(f"a row lacks one of {', '.join(keys)}")).cast("boolean")).otherwise(F.lit(True)))


def read_businesses(spark: SparkSession, path: str) -> DataFrame:
    """A malformed line or a missing required key fails the job; absent optional keys are null."""
    return _checked(spark.read.schema(BUSINESS_JSON).option("mode", "FAILFAST").json(path), REQUIRED["business"])


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return _checked(spark.read.schema(REVIEW_JSON).option("mode", "FAILFAST").json(path), REQUIRED["review"])


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``value``: the line as it stands; ``row``: what is in it."""
    return spark.read.text(path).withColumn("row", F.from_json("value", schema, {"mode": "FAILFAST"}))


def business_condition(city: str | None = None, state: str | None = None, category: str | None = "Restaurants", row: str = "row") -> Column:
    """Equal city and state, case ignored and the row's side stripped; the category as a part of the list. None and '' disable."""

    def field(name: str) -> Column:
        return F.coalesce(F.col(f"{row}.{name}") if row else F.col(name), F.lit(""))

    keep = F.lit(True)
    for name, wanted in (("city", city), ("state", state)):
        if wanted:
            keep = keep & (F.lower(strip(field(name))) == wanted.lower())
    if category:
        keep = keep & F.contains(F.lower(field("categories")), F.lit(category.lower()))
    return keep


def filter_business_lines(lines: DataFrame, **wanted: str | None) -> DataFrame:
    """The lines of the businesses that meet ``business_condition``, unchanged."""
    return lines.where(business_condition(**wanted))


def filter_review_lines(lines: DataFrame, business_lines: DataFrame) -> DataFrame:
    """The lines of the reviews of these businesses, repeated ones kept."""
    ids = business_lines.select(F.col("row.business_id").alias("_id")).distinct()
    return lines.join(ids, F.col("row.business_id") == F.col("_id"), "left_semi")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("error").text(path)


def filter_dataset(spark: SparkSession, businesses: str, reviews: str, out: str, **wanted: str | None) -> None:
    """Both files cut down to the wanted businesses. Fails if none is left, after their (empty) file is written."""
    kept = filter_business_lines(read_lines(spark, businesses, BUSINESS_JSON), **wanted)
    write_lines(kept, f"{out}/business")
    if kept.isEmpty():
        raise ValueError("no business meets the conditions")
    write_lines(filter_review_lines(read_lines(spark, reviews, REVIEW_JSON), kept), f"{out}/review")
