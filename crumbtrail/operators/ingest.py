"""Loading deliveries into the tables: upsert, insert-ignore, foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.functions.text import split_csv


def incoming_businesses(raw: DataFrame) -> DataFrame:
    """Delivered businesses in the table's columns."""
    return raw.select(
        F.col("business_id").alias("yelp_business_id"), "name", "address", "city", "state", "postal_code", split_csv(F.col("categories")).alias("categories"), F.col("stars").alias("yelp_stars"), F.col("review_count").alias("yelp_review_count")
    )


def incoming_reviews(raw: DataFrame) -> DataFrame:
    """Delivered reviews in the table's columns (``business_id`` is still the source's): whole stars, and the date of a text.

    A date-time text gives its date. A text that is no date, or a star that is no number, fails the job, as null is allowed only where
    nothing was given.
    """
    return raw.select(F.col("review_id").alias("yelp_review_id"), "business_id", F.col("stars").cast("short").alias("stars"), F.col("text").alias("review_text"), F.col("date").cast("date").alias("review_date"))


#: What a later delivery of a business changes; the rest stays as first written.
UPDATED = ("name", "address", "postal_code", "yelp_stars", "yelp_review_count")
KEPT = ("city", "state", "categories")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, seq: str, updated: tuple[str, ...], kept: tuple[str, ...]) -> DataFrame:
    """One row per key. ``updated`` columns take the last row's value, even a null; ``kept`` ones the first row's.

    ``seq`` orders the rows of both sides, the existing ones first. Aggregation is partial before the shuffle.
    """
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    at = F.struct("_side", seq)
    return both.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in updated], *[F.min_by(c, at).alias(c) for c in kept])


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """The incoming rows that are inserted: the first of each key that is not there yet."""
    first = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(seq))).where("_r = 1").drop("_r")
    return first.join(existing.select(key), key, "left_anti")


def with_business(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    """Reviews with the internal ``business_id`` of their source id; reviews of others are skipped."""
    ids = businesses.select("yelp_business_id", F.col("id").alias("_business")).dropDuplicates(["yelp_business_id"])
    return reviews.join(ids, reviews["business_id"] == ids["yelp_business_id"]).drop("business_id", "yelp_business_id").withColumnRenamed("_business", "business_id")


def load_counts(attempted: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: how many rows were tried and how many were inserted."""
    return attempted.agg(F.count("*").alias("attempted")).crossJoin(F.broadcast(inserted.agg(F.count("*").alias("inserted"))))  # one row each


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows of ``child`` whose key ``parent`` lacks. A null key has no parent."""
    ids = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.join(ids, child[key] == ids["_pk"], "left_anti")
