"""Declared schemas of the sources and tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


#: Newline-delimited JSON as delivered.
BUSINESS_JSON = _struct(
    ("business_id", T.StringType()), ("name", T.StringType()), ("address", T.StringType()), ("city", T.StringType()), ("state", T.StringType()),
    ("postal_code", T.StringType()), ("categories", T.StringType()), ("stars", T.DecimalType(2, 1)), ("review_count", T.IntegerType()),
)
REVIEW_JSON = _struct(("review_id", T.StringType()), ("business_id", T.StringType()), ("text", T.StringType()), ("stars", T.DoubleType()), ("date", T.StringType()))
#: Keys without which a row is an error.
REQUIRED = {"business": ("business_id", "name"), "review": ("review_id", "business_id", "text")}

#: One extracted mention, and what an extractor gives for a review.
MENTION = _struct(("dish", T.StringType()), ("sentiment", T.StringType()), ("tags", T.ArrayType(T.StringType())))
MENTIONS = T.ArrayType(MENTION)
SENTIMENTS = ("positive", "negative", "neutral")

PROFILE = _struct(
    ("business_id", T.LongType()), ("name", T.StringType()), ("mention_count", T.LongType()), ("positive_count", T.LongType()), ("negative_count", T.LongType()),
    ("tags", T.ArrayType(T.StringType())), ("embedding", T.ArrayType(T.FloatType())), ("blurb", T.StringType()),
)
