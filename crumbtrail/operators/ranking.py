"""Ranking items by votes, and the categories they fall into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.functions.categories import KEYWORDS, categories_of
from crumbtrail.functions.scores import weighted_score

CONFIDENCE = 5.0


def rank_dishes(profiles: DataFrame, top_n: int | None = 10, min_mentions: int = 3, confidence: float = CONFIDENCE, order: str = "id") -> DataFrame:
    """Eligible items with ``score`` and ``rank`` within their business.

    Eligible: at least ``min_mentions`` mentions and a vote. The score draws an item's share of positive
    votes to the pooled share of all eligible items of its business. Ties: more mentions, then ``order``.
    """
    if min_mentions < 1 or confidence < 0 or (top_n is not None and not 1 <= top_n <= 10):
        raise ValueError("top_n must be 1 to 10, min_mentions at least 1, confidence not negative")
    fit = profiles.where((F.col("mention_count") >= min_mentions) & (F.col("positive_count") + F.col("negative_count") > 0))
    # The pooled share by partial aggregation: no window over a business's rows.
    pooled = fit.groupBy("business_id").agg((F.sum("positive_count").cast("double") / F.sum(F.col("positive_count") + F.col("negative_count")).cast("double")).alias("_prior"))
    scored = fit.join(pooled, "business_id").withColumn("score", weighted_score(F.col("positive_count"), F.col("negative_count"), F.col("_prior"), confidence)).drop("_prior")
    w = Window.partitionBy("business_id").orderBy(F.col("score").desc(), F.col("mention_count").desc(), order)
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if top_n is None else ranked.where(F.col("rank") <= top_n)


def filter_by_categories(profiles: DataFrame, selected: list[str]) -> DataFrame:
    """Items in any selected category, case ignored; no selection keeps all, unknown names match none."""
    if not selected:
        return profiles
    return profiles.where(F.arrays_overlap(categories_of(F.col("tags")), F.array(*[F.lit(s.lower()) for s in selected])))


def category_counts(profiles: DataFrame, cap: int = 10, order: str = "id") -> DataFrame:
    """business_id, category, count (at most ``cap``), position: categories in the order they are met.

    Items are gone through by ``order``; an item's categories come in the order of the keyword table.
    """
    names = list(KEYWORDS)
    spot = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category"))
    long = profiles.select("business_id", F.col(order).alias("_o"), F.explode(categories_of(F.col("tags"))).alias("category"))
    counts = long.groupBy("business_id", "category").agg(F.least(F.count("*"), F.lit(cap)).alias("count"), F.min(F.struct(F.col("_o"), spot.alias("p"))).alias("_at"))
    w = Window.partitionBy("business_id").orderBy("_at")
    return counts.withColumn("position", F.row_number().over(w)).drop("_at")
