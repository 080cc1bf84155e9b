"""The N best items of each group, taken band by band from the top of the scores.

Items are written once, split into score bands. The bands are read from the highest down; groups
that are already full are anti-joined away, so a lower band is only read for the groups that still
lack items. In the band where a group becomes full, exact ranking by all keys settles its places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.session import stage

#: Shares of the items at or below which the bands end, from the top.
BAND_SHARES = (0.9, 0.6)


def top_by_bands(df: DataFrame, group: str, item: str, scores: list[str], n: int, band_shares: tuple[float, ...] = BAND_SHARES) -> DataFrame:
    """group, item, rank_no: the first ``n`` items of each group, scores descending, then item id.

    Null scores count as 0; an item with a null group or id is left out; an item delivered
    twice counts once. Ties in all scores go to the smaller id. Groups with fewer items give what
    they have; no items, no rows. A group may hold any share of the rows: ranking within a band
    keeps at most ``n`` rows of a group per partition before any shuffle. Other columns are not read.
    """
    keys = [f"_s{k}" for k in range(len(scores))]
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("_g"), F.col(item).alias("_i"), *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(k) for s, k in zip(scores, keys)]
    )
    # A few bounds over all scores, at a fixed relative error.
    found = rows.agg(F.percentile_approx(keys[0], list(band_shares), 1000)).first()[0] if band_shares else None
    bounds = sorted(set(found or []), reverse=True)
    band = reduce(lambda when, k: when.when(F.col(keys[0]) >= bounds[k], k), range(1, len(bounds)), F.when(F.col(keys[0]) >= bounds[0], 0)).otherwise(len(bounds)) if bounds else F.lit(0)
    banded = stage(rows.dropDuplicates(["_i"]).withColumn("_band", band), "bands", "_band")
    order = [F.col(k).desc() for k in keys] + [F.col("_i").asc()]
    kept = filled = None
    for k in range(len(bounds) + 1):
        part = banded.where(F.col("_band") == k).drop("_band")
        if kept is None:
            have = part.select("_g").limit(0).withColumn("_have", F.lit(0).cast("long"))
        else:
            have = kept.groupBy("_g").agg(F.count("*").alias("_have"))
            filled = have.where(F.col("_have") >= n).select("_g")
            part = part.join(filled, "_g", "left_anti")
        # At most n of a group can still matter, so the band is cut to its n best before the exact places.
        best = part.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).where(F.col("_r") <= n)
        placed = best.join(have, "_g", "left").withColumn("rank_no", F.col("_r").cast("long") + F.coalesce("_have", F.lit(0)))
        taken = placed.where(F.col("rank_no") <= n).select("_g", "_i", "rank_no")
        kept = stage(taken if kept is None else kept.unionByName(taken), "taken")
    return kept.select(F.col("_g").alias(group), F.col("_i").alias(item), "rank_no")
