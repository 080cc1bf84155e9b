"""Queries and SQL over the texts of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crumbtrail.llm.near_duplicates import all_pairs, near_duplicates
from crumbtrail.llm.pii import find_pii, mask_pii
from crumbtrail.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return all_pairs(*near_duplicates(table(spark, folder, "reviews"), "id", "review_text"))


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "reviews"), "id", "review_text")[1]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(table(spark, folder, "reviews"), "id", "review_text").withColumnRenamed("id", "review_id")


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    return mask_pii(table(spark, folder, "reviews"), "id", "review_text").withColumnRenamed("id", "review_id")


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p2_found": p2_found, "p2_masked": p2_masked}

SQL = {
    "p1_found": r"""
        WITH r AS (SELECT id, any_value(regexp_extract_all(lower(review_text), '[\p{L}\p{N}]+')) AS w FROM reviews GROUP BY id),
        g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM r WHERE len(w) >= 20)),
        n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
        o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS hits FROM g a JOIN g b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * hits >= x.n + y.n - hits""",
    "p1_links": r"""
        WITH r AS (SELECT id, any_value(regexp_extract_all(lower(review_text), '[\p{L}\p{N}]+')) AS w FROM reviews GROUP BY id),
        c AS (SELECT min(id) AS id, w FROM r WHERE len(w) >= 20 GROUP BY w),
        g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM c)),
        n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
        o AS (SELECT a.id AS a, b.id AS b, count(*) AS hits FROM g a JOIN g b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
        SELECT a, b, CAST(hits AS DOUBLE) / (x.n + y.n - hits) AS similarity FROM o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2 * hits >= x.n + y.n - hits""",
}
