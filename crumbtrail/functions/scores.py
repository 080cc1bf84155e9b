"""Scores, shares and their labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive_ratio(positive: Column, votes: Column) -> Column:
    """Null where there are no votes."""
    return F.try_divide(positive.cast("double"), votes.cast("double"))


def weighted_score(positive: Column, negative: Column, prior: Column, confidence: float) -> Column:
    """Own share pulled to the prior: weight v/(v+C) on the own share."""
    votes = (positive + negative).cast("double")
    own = F.try_divide(votes, votes + F.lit(float(confidence)))
    return own * positive_ratio(positive, votes) + (F.lit(1.0) - own) * prior


def percent_positive(positive: Column, negative: Column) -> Column:
    """Rounded half up; 50 without votes."""
    votes = positive + negative
    share = F.floor(F.try_divide(positive.cast("double") * 100, votes.cast("double")) + 0.5)
    return F.when(votes > 0, share).otherwise(F.lit(50)).cast("long")


def band(percent: Column) -> Column:
    return F.when(percent >= 80, "positive").when(percent >= 40, "mixed").otherwise("negative")


def chip(count: Column, cap: int = 10) -> Column:
    """The count as text, ``10+`` from the cap on."""
    return F.when(count >= cap, F.lit(f"{cap}+")).otherwise(count.cast("string"))
