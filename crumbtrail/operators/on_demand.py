"""Profiles on demand: only what is missing is extracted or built, for all asked businesses in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crumbtrail.operators.pending import pending, work_list
from crumbtrail.operators.profiles import build_profiles

EXTRACT, CACHED, AGGREGATE = "extract", "cached", "aggregate"
COLUMNS = ("business_id", "name", "mention_count", "positive_count", "negative_count", "tags")


def states(businesses: DataFrame, reviews: DataFrame, stored: DataFrame) -> DataFrame:
    """business_id, state: ``extract`` with a pending review, else ``cached`` with a stored profile, else ``aggregate``.

    Both sides are cut to one row per business before they are joined.
    """
    asked = businesses.where(F.col("id").isNotNull()).select(F.col("id").alias("business_id")).distinct()
    waits = pending(reviews).select("business_id").distinct().withColumn("_waits", F.lit(True))
    held = stored.select("business_id").distinct().withColumn("_held", F.lit(True))
    state = F.when(F.col("_waits"), EXTRACT).when(F.col("_held"), CACHED).otherwise(AGGREGATE)
    return asked.join(waits, "business_id", "left").join(held, "business_id", "left").select("business_id", state.alias("state"))


def profiles_on_demand(businesses: DataFrame, reviews: DataFrame, mentions: DataFrame, stored: DataFrame, extracted: Callable[[DataFrame], DataFrame], vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(profiles of the asked businesses with their ``state``, mentions that are new).

    ``extracted`` gives ``mention_rows`` of a work list; it is only given the pending
    reviews of the asked businesses. Their profiles are built anew from all their mentions, as are those of businesses that have no
    stored one; the others' are read as they are stored. New mentions come after the stored ones in order, by review and
    name. The caller stores new mentions and profiles (``overwrite_partitions``), and stamps the reviews.
    """
    state = states(businesses, reviews, stored)
    todo = work_list(reviews.join(state.where(F.col("state") == EXTRACT), "business_id", "left_semi"), ordered=False)
    new = extracted(todo)
    last = mentions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    # An id behind all stored ones, the same in each run: by review, then by the mention's place in it.
    numbered = new.crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + 1 + F.shiftleft("review_id", 20) + F.col("position"))  # one row
    both = mentions.select("id", "business_id", "dish_name", "sentiment", "tags").unionByName(numbered.select("id", "business_id", "dish_name", "sentiment", "tags"))
    fresh = both.join(state.where(F.col("state") != CACHED), "business_id", "left_semi")
    built = build_profiles(fresh, vectors).select(*COLUMNS).join(state, "business_id")
    read = stored.select(*COLUMNS).join(state.where(F.col("state") == CACHED), "business_id")
    return built.unionByName(read), new
