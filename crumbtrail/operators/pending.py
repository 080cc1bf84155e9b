"""Which reviews still wait for extraction, in what order, and the ledger of those that are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(reviews: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Reviews without a stamp and not in the ledger (review_id, extracted_at)."""
    open_ = reviews.where(F.col("extracted_at").isNull())
    return open_ if ledger is None else open_.join(ledger.select(F.col("review_id").alias("id")), "id", "left_anti")


def longest_per_business(reviews: DataFrame, k: int) -> DataFrame:
    """The ``k`` longest of each business, the smaller id first among equals; a null text is shortest."""
    w = Window.partitionBy("business_id").orderBy(F.length("review_text").desc_nulls_last(), "id")
    return reviews.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def work_list(reviews: DataFrame, business_id: int | None = None, limit: int | None = None, max_per_business: int | None = None, ordered: bool = True) -> DataFrame:
    """id, business_id, review_text of what is to be extracted next; the limit applies last.

    By id, or by business and id where a business is capped. Without ``ordered`` the whole list is not sorted, as extraction
    needs no order; a limit always takes the first ones.
    """
    todo = pending(reviews)
    if business_id is not None:
        todo = todo.where(F.col("business_id") == business_id)
    order = ["id"]
    if max_per_business is not None:
        todo, order = longest_per_business(todo, max_per_business), ["business_id", "id"]
    todo = todo.select("id", "business_id", "review_text")
    if limit is not None:
        return todo.orderBy(*order).limit(limit)
    return todo.orderBy(*order) if ordered else todo


def stamps(review_ids: DataFrame) -> DataFrame:
    """Ledger rows for these reviews, whether or not anything was found in them."""
    return review_ids.select("review_id").distinct().withColumn("extracted_at", F.current_timestamp())


def length_study(reviews: DataFrame, mentions: DataFrame, bounds: tuple[int, ...] = (200, 500, 900)) -> DataFrame:
    """bucket, n_reviews, zero_rate, mean_mentions of the extracted reviews by length."""
    found = mentions.groupBy("review_id").agg(F.count("*").alias("n"))
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + (F.length("review_text") >= b).cast("int")
    done = reviews.where(F.col("extracted_at").isNotNull() & F.col("review_text").isNotNull()).select("id", bucket.alias("bucket"))
    counts = done.join(found, done["id"] == found["review_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.groupBy("bucket").agg(F.count("*").alias("n_reviews"), F.avg((F.col("n") == 0).cast("double")).alias("zero_rate"), F.avg(F.col("n").cast("double")).alias("mean_mentions"))
