"""One profile per distinct item: exact grouping of names, then clusters of similar ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.functions.text import normalize, strip
from crumbtrail.functions.vectors import mean_pool
from crumbtrail.operators.similarity import components, similar_pairs
from crumbtrail.session import stage

TOP_TAGS = 5


def keyed(mentions: DataFrame) -> DataFrame:
    """Mentions with ``key``, the normalised name, and ``surface``, the name as written."""
    return mentions.select("id", "business_id", normalize(F.col("dish_name")).alias("key"), strip(F.col("dish_name")).alias("surface"), "sentiment", "tags")


def group_names(mentions: DataFrame) -> DataFrame:
    """business_id, key, counts and first mention of each normalised name; neutral mentions only count as such."""
    return _groups(keyed(mentions))


def _groups(named: DataFrame) -> DataFrame:
    return named.groupBy("business_id", "key").agg(
        F.count("*").alias("mention_count"), F.count_if(F.col("sentiment") == "positive").alias("positive_count"), F.count_if(F.col("sentiment") == "negative").alias("negative_count"), F.min("id").alias("first_id")
    )


def _clusters(groups: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """business_id, key, cluster: the key of the member that was seen first. Without clusters each name is its own."""
    if clusters is None:
        return groups.select("business_id", "key", "first_id", F.col("key").alias("cluster"), F.col("first_id").alias("cluster_first"))
    named = groups.join(clusters, ["business_id", "key"], "left").withColumn("component", F.coalesce("component", "key"))
    first = named.groupBy("business_id", "component").agg(F.min_by("key", "first_id").alias("cluster"), F.min("first_id").alias("cluster_first"))
    return named.join(first, ["business_id", "component"]).select("business_id", "key", "first_id", "cluster", "cluster_first")


def cluster_names(groups: DataFrame, vectors: DataFrame, threshold: float = 0.87) -> DataFrame:
    """business_id, key, component by single linkage over the names' vectors (business_id, key, embedding)."""
    known = groups.join(vectors, ["business_id", "key"])
    return components(groups, similar_pairs(known, "business_id", "key", "embedding", threshold), "business_id", "key")


def canonical_names(mentions: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """business_id, cluster, name: the most frequent spelling as written.

    Ties go to the spelling met first when the members are gone through in the order of their first mention.
    """
    named = keyed(mentions)
    return _names(named, _clusters(_groups(named), clusters))


def _names(named: DataFrame, members: DataFrame) -> DataFrame:
    spelled = named.groupBy("business_id", "key", "surface").agg(F.count("*").alias("n"), F.min("id").alias("pos"))
    order = F.struct("first_id", "pos")
    total = spelled.join(members, ["business_id", "key"]).groupBy("business_id", "cluster", "surface").agg(F.sum("n").alias("n"), F.min(order).alias("at"))
    return total.groupBy("business_id", "cluster").agg(F.max_by("surface", F.struct("n", (-F.col("at.first_id")).alias("a"), (-F.col("at.pos")).alias("b"))).alias("name"))


def top_tags(mentions: DataFrame, clusters: DataFrame | None = None, k: int = TOP_TAGS) -> DataFrame:
    """business_id, cluster, tags: up to ``k`` by frequency, as written, repeats within a mention counted; ties as for names."""
    named = keyed(mentions)
    return _tags(named, _clusters(_groups(named), clusters), k)


def _tags(named: DataFrame, members: DataFrame, k: int) -> DataFrame:
    long = named.select("business_id", "key", "id", F.posexplode("tags").alias("at", "tag"))
    seen = long.groupBy("business_id", "key", "tag").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("pos"))
    total = seen.join(members, ["business_id", "key"]).groupBy("business_id", "cluster", "tag").agg(F.sum("n").alias("n"), F.min(F.struct("first_id", "pos")).alias("pos"))
    w = Window.partitionBy("business_id", "cluster").orderBy(F.col("n").desc(), "pos")
    best = total.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy("business_id", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]).alias("tags"))


def build_profiles(mentions: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.87) -> DataFrame:
    """business_id, name, counts, tags, embedding, cluster_rank: profiles of all businesses in one plan.

    With ``vectors`` (business_id, key, embedding), names within a cosine of ``threshold`` are one item, directly or
    through others; its embedding is the mean over its distinct names. ``cluster_rank`` is the order of first mention.
    """
    # Mentions and the clusters of their names are made once; names, tags and vectors read them.
    named = stage(keyed(mentions), "mentions")
    groups = _groups(named)
    if vectors is not None:
        groups = stage(groups, "groups")
    members = _clusters(groups, None if vectors is None else cluster_names(groups, vectors, threshold))
    if vectors is not None:
        members = stage(members, "members")
    counts = groups.drop("first_id").join(members, ["business_id", "key"]).groupBy("business_id", "cluster").agg(
        *[F.sum(c).alias(c) for c in ("mention_count", "positive_count", "negative_count")], F.min("cluster_first").alias("cluster_rank")
    )
    out = counts.join(_names(named, members), ["business_id", "cluster"]).join(_tags(named, members, TOP_TAGS), ["business_id", "cluster"], "left")
    if vectors is None:
        out = out.withColumn("embedding", F.lit(None).cast("array<double>"))
    else:
        pooled = mean_pool(members.join(vectors, ["business_id", "key"]), ["business_id", "cluster"], "embedding")
        out = out.join(pooled, ["business_id", "cluster"], "left")
    none = F.array().cast("array<string>")
    return out.select("business_id", "name", "mention_count", "positive_count", "negative_count", F.coalesce("tags", none).alias("tags"), "embedding", "cluster_rank")
