"""Lookup of businesses by name or id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.functions.text import address_line

SHOWN = 20


def find_businesses(businesses: DataFrame, name: str | None = None, business_id: int | None = None) -> DataFrame:
    """By id if one is given, else by a part of the name, case ignored; %, _ and \\ in it are wildcards and escape. By name, then id."""
    if business_id is not None:
        return businesses.where(F.col("id") == business_id)
    if not (name or "").strip():
        raise ValueError("a name or an id is needed")
    return businesses.where(F.col("name").ilike(f"%{name}%")).orderBy("name", "id")


def matches(found: DataFrame) -> DataFrame:
    """Response rows with a label ``name — address``."""
    return found.select(
        F.col("id").alias("business_id"), "name", "address", "city", "state", "postal_code", address_line(F.col("name"), F.col("address"), F.col("city"), F.col("state"), F.col("postal_code")).alias("label")
    )


def first_matches(found: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first ``shown`` by name and id, each with the number of those not shown."""
    total = found.agg(F.count("*").alias("_n"))
    head = found.orderBy("name", "id").limit(shown)
    return head.crossJoin(F.broadcast(total)).withColumn("overflow", F.greatest(F.col("_n") - shown, F.lit(0))).drop("_n")  # one row


def name_of(businesses: DataFrame, business_id: int) -> str:
    row = businesses.where(F.col("id") == business_id).select("name").first()
    if row is None:
        raise LookupError(f"no business {business_id}")
    return row["name"]


def exists(businesses: DataFrame, business_id: int) -> bool:
    return not businesses.where(F.col("id") == business_id).limit(1).isEmpty()


def review_text(reviews: DataFrame, review_id: int) -> str:
    """The text of one review, read by its id; an error if there is none."""
    row = reviews.where(F.col("id") == review_id).select("review_text").first()
    if row is None:
        raise LookupError(f"no review {review_id}")
    return row["review_text"]


def suggestions(businesses: DataFrame, typed: str, least: int = 2) -> DataFrame:
    """Matches of what is being typed: none before ``least`` letters, blanks at the ends not counted."""
    text = typed.strip()
    if len(text) < least:
        return matches(businesses.limit(0))
    return matches(find_businesses(businesses, text))


def listing(profiles: DataFrame, order: str = "id") -> DataFrame:
    """``profiles`` with ``position`` within their business: most mentioned first, then by ``order``."""
    w = Window.partitionBy("business_id").orderBy(F.col("mention_count").desc(), order)
    return profiles.withColumn("position", F.row_number().over(w))


def pick(found: DataFrame, n: int) -> DataFrame:
    """The n-th match, from 1; an error outside of what is shown."""
    rows = found.orderBy("name", "id").limit(SHOWN).tail(SHOWN) if n >= 1 else []
    if n > len(rows) or n < 1:
        raise ValueError(f"pick 1 to {len(rows)}")
    return found.where(F.col("id") == rows[n - 1]["id"])
