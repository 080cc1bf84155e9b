"""Maintenance that shrinks the stored tables, with extracted data protected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_cities(raw: str) -> list[tuple[str, str]]:
    """``City:ST, City:ST`` as pairs; an entry without a city or without a state is an error."""
    pairs = []
    for entry in raw.split(","):
        city, state = (part.strip() for part in entry.partition(":")[::2])
        if not (city and state):
            raise ValueError(f"not City:ST: {entry.strip()!r}")
        pairs.append((city, state))
    return pairs


def in_cities(cities: list[tuple[str, str]]) -> Column:
    """Case ignored, the row's side not stripped."""
    return reduce(lambda a, b: a | b, [(F.lower("city") == c.lower()) & (F.lower("state") == s.lower()) for c, s in cities], F.lit(False))


def rated_at_least(stars: float) -> Column:
    return F.col("yelp_stars").isNull() | (F.col("yelp_stars") >= F.lit(stars))


def keep_businesses(businesses: DataFrame, condition: Column, extractions: DataFrame) -> DataFrame:
    """Businesses that meet the condition or have extractions."""
    held = extractions.select(F.col("business_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("_held", F.lit(True))
    return businesses.join(held, "id", "left").where(F.coalesce(condition, F.lit(False)) | F.col("_held")).drop("_held")


def reviews_of(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    return reviews.join(businesses.select(F.col("id").alias("business_id")), "business_id", "left_semi")


def whole_extractions(extractions: DataFrame, businesses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Extractions whose business and review are both there."""
    kept = extractions.join(businesses.select(F.col("id").alias("business_id")), "business_id", "left_semi")
    return kept.join(reviews.select(F.col("id").alias("review_id")), "review_id", "left_semi")


def cap_reviews(reviews: DataFrame, k: int) -> DataFrame:
    """All extracted reviews, and the longest others while a business has fewer than ``k`` in all.

    Extracted reviews count first. Ties go to the smaller id. Only reviews that aren't extracted are ranked,
    so a business's extracted reviews are counted, not sorted.
    """
    done = reviews.where(F.col("extracted_at").isNotNull())
    have = done.groupBy(F.col("business_id").alias("_b")).agg(F.count("*").alias("_have"))
    w = Window.partitionBy("business_id").orderBy(F.length("review_text").desc_nulls_last(), "id")
    rest = reviews.where(F.col("extracted_at").isNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    rest = rest.join(have, F.col("business_id").eqNullSafe(F.col("_b")), "left").where(F.col("_r") <= F.lit(k) - F.coalesce("_have", F.lit(0)))
    return done.unionByName(rest.select(*reviews.columns))


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, after and removed."""
    counts = before.agg(F.count("*").alias("n_before")).crossJoin(F.broadcast(after.agg(F.count("*").alias("n_after"))))  # one row each
    return counts.withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def next_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One row: the largest id, 1 for an empty table."""
    return df.agg(F.coalesce(F.max(key), F.lit(1).cast("long")).alias("last_id"))
