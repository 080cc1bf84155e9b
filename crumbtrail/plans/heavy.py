"""Queries and SQL of the figures per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crumbtrail.operators.heavy_keys import heavy_keys, key_figures
from crumbtrail.sources.tables import table


def p7_figures(spark: SparkSession, folder: str) -> DataFrame:
    return key_figures(table(spark, folder, "reviews"), "id", "business_id", "stars", "review_text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(p7_figures(spark, folder), "business_id", 0.01).select("business_id")


QUERIES = {"p7_found": p7_found, "p7_figures": p7_figures}

SQL = {
    "p7_found": """
        WITH r AS (SELECT DISTINCT id, business_id FROM reviews)
        SELECT business_id FROM r WHERE business_id IS NOT NULL
        GROUP BY business_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM r)""",
    "p7_figures": """
        WITH r AS (SELECT DISTINCT id, business_id, stars, length(review_text) AS n FROM reviews)
        SELECT business_id, count(*) AS n_records, count(stars) AS n_values,
               CAST(coalesce(sum(stars), 0) AS DOUBLE) AS sum_values, avg(stars) AS mean_value,
               CAST(max(n) AS BIGINT) AS longest
        FROM r GROUP BY business_id""",
}
