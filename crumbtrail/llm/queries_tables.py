"""Queries and SQL over names, dishes and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.llm.grid_components import matched_names
from crumbtrail.llm.score_bands import top_by_bands
from crumbtrail.llm.term_counts import marked, merge_counts, read_counts, signed_changes
from crumbtrail.llm.variant_names import name_groups, name_pairs
from crumbtrail.session import stage_path
from crumbtrail.sources.tables import table

SPACE = r"[\s\x{A0}\x{1c}-\x{1f}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+"


def _norm(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{SPACE}', ' ', 'g')))"


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return matched_names(table(spark, folder, "name_matches"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    top = top_by_bands(table(spark, folder, "dishes"), "business_id", "id", ["positive_count", "mention_count"], 10)
    return top.select("business_id", F.col("id").alias("dish_id"), "rank_no")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    there = table(spark, folder, "businesses").select(F.col("id").alias("business_id")).distinct()
    return name_groups(table(spark, folder, "dish_extractions").join(there, "business_id", "left_semi"), "business_id", "dish_name", "id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return name_pairs(p5_groups(spark, folder), "business_id")


def _tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts after a first delivery and a correction.

    The first delivery has every mention, those with a sentiment outside the allowed set without
    their tags; the correction then delivers these again as they are.
    """
    records = table(spark, folder, "dish_extractions").select("id", "tags", "sentiment")
    odd = ~F.coalesce(F.col("sentiment").isin("positive", "negative", "neutral"), F.lit(False))
    first = records.select("id", F.when(~odd, F.col("tags")).alias("tags"))
    path = stage_path(spark, "tag-counts")
    merge_counts(spark, path, signed_changes(None, first, "id", "tags"), 1)
    again = records.where(odd)
    merge_counts(spark, path, signed_changes(first.join(again.select("id").distinct(), "id", "left_semi"), again, "id", "tags"), 2)
    return read_counts(spark, path)


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "dish_extractions").agg(F.count_distinct("id"))
    return marked(_tag_counts(spark, folder), n).select(F.col("term").alias("tag"), "occurrences", F.col("records").alias("mentions"), "mark")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_counts(spark, folder).where(F.col("mark").isNotNull()).select("tag", "mark")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_counts": p6_counts}

_TAGS = f"""
    WITH m AS (SELECT id, any_value(tags) AS tags FROM dish_extractions GROUP BY id),
    t AS (SELECT id, {_norm("x")} AS tag FROM (SELECT id, unnest(tags) AS x FROM m) WHERE x IS NOT NULL),
    c AS (SELECT tag, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT id) AS BIGINT) AS mentions FROM t WHERE tag <> '' GROUP BY tag),
    k AS (SELECT *, CASE WHEN mentions < 3 THEN 'rare' WHEN mentions > 0.1 * (SELECT count(*) FROM m) THEN 'common' END AS mark FROM c)"""

SQL = {
    "p3_found": f"""
        WITH RECURSIVE e AS (
            SELECT DISTINCT business_id, {_norm("name_a")} AS a, {_norm("name_b")} AS b FROM name_matches
            WHERE name_a IS NOT NULL AND name_b IS NOT NULL AND NOT isnan(similarity) AND similarity >= 0.87),
        u AS (SELECT business_id, a, b FROM e WHERE a <> b AND a <> '' AND b <> '' UNION SELECT business_id, b, a FROM e WHERE a <> b AND a <> '' AND b <> ''),
        r(business_id, name, reached) AS (
            SELECT business_id, a, b FROM u
            UNION SELECT r.business_id, r.name, u.b FROM r JOIN u ON r.business_id = u.business_id AND r.reached = u.a)
        SELECT business_id, name, min(reached) AS group_name FROM r GROUP BY business_id, name""",
    "p4_found": """
        WITH d AS (SELECT DISTINCT id, business_id, coalesce(positive_count, 0) AS p, coalesce(mention_count, 0) AS m FROM dishes),
        k AS (SELECT business_id, id AS dish_id, row_number() OVER (PARTITION BY business_id ORDER BY p DESC, m DESC, id) AS rank_no FROM d)
        SELECT business_id, dish_id, CAST(rank_no AS BIGINT) AS rank_no FROM k WHERE rank_no <= 10""",
    "p6_counts": _TAGS + " SELECT tag, occurrences, mentions, mark FROM k",
    "p6_found": _TAGS + " SELECT tag, mark FROM k WHERE mark IS NOT NULL",
}
