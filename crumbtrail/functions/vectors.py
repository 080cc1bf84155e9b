"""Vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector, as it has no direction."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The unweighted mean by dimension for each group; rows without a vector don't count.

    A group of one row is its vector. Of the others, dimensions are summed before they are shuffled, so that a group sends
    one number for each dimension and task.
    """
    given = df.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    counted = given.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value("_v").alias("_v"))
    single = counted.where("_n = 1").select(*keys, F.col("_v").alias(vector))
    long = given.join(counted.where("_n > 1").select(*keys), keys, "left_semi").select(*keys, F.posexplode("_v").alias("dim", "x"))
    means = long.groupBy(*keys, "dim").agg(F.avg("x").alias("x"))
    packed = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return single.unionByName(packed.select(*keys, F.transform("v", lambda e: e["x"]).alias(vector)))
