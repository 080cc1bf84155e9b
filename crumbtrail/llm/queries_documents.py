"""Queries and SQL over documents and test passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.functions.text import normalize
from crumbtrail.llm.leakage import build_index, passage_terms, phrase_matches, proximity_matches
from crumbtrail.llm.mixing import BLOCKS, count_tokens, mixture, quotas, reachable_total, reached_shares
from crumbtrail.llm.spam_pages import page_scores, spam_pages
from crumbtrail.session import stage
from crumbtrail.sources.tables import table

RUN_WORDS = 12
#: Words of a passage that must be close together, and within how many.
NEAR_TERMS, NEAR_SPAN = 3, 30


def _index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    index = build_index(table(spark, folder, "documents"), "doc_id", "text")
    return index, passage_terms(table(spark, folder, "eval_passages"), index, "item_id", "passage")


def p8_runs(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_matches(*_index(spark, folder), RUN_WORDS)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_runs(spark, folder).select("doc_id", "item_id").distinct()


def p8_proximity(spark: SparkSession, folder: str) -> DataFrame:
    return proximity_matches(*_index(spark, folder), NEAR_TERMS, NEAR_SPAN)


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    counted = stage(count_tokens(docs, "doc_id", "text", "source"), "tokens")
    return counted, targets, mixture(counted, targets)


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[2]


def p9_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """The apportionment by the number of words, which SQL can count too."""
    docs, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    counted = docs.select("doc_id", normalize(F.col("source")).alias("source"), F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).cast("long").alias("n_tokens"))
    return quotas(counted, targets)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return reached_shares(*_mix(spark, folder))


def p9_exact_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of the largest mixture in which every source that has texts reaches its target."""
    counted, targets, _ = _mix(spark, folder)
    return reached_shares(counted, targets, mixture(counted, targets, reachable_total(counted, targets)))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return page_scores(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages(p10_scores(spark, folder))


QUERIES = {"p8_found": p8_found, "p8_runs": p8_runs, "p8_proximity": p8_proximity, "p9_mixture": p9_mixture, "p9_quotas": p9_quotas, "p9_shares": p9_shares, "p9_exact_shares": p9_exact_shares, "p10_found": p10_found, "p10_scores": p10_scores}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

SQL = {
    "p8_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        e AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_passages),
        dg AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {RUN_WORDS - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {RUN_WORDS - 2})) AS i FROM d)),
        eg AS (SELECT DISTINCT item_id, list_slice(w, i, i + {RUN_WORDS - 1}) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {RUN_WORDS - 2})) AS i FROM e))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p9_quotas": rf"""
        WITH c AS (SELECT lower(trim(regexp_replace(source, '\s+', ' ', 'g'))) AS source, len({_WORDS.format("coalesce(text, '')")}) AS n FROM documents),
        g AS (SELECT source, g.share AS share, g.repeats AS repeats FROM (SELECT lower(trim(regexp_replace(source, '\s+', ' ', 'g'))) AS source, max({{'share': target_share, 'repeats': max_repeats}}) AS g FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 GROUP BY 1)),
        t AS (SELECT source, share, repeats, n FROM c JOIN g USING (source) WHERE n > 0),
        z AS (SELECT CAST(sum(n) AS BIGINT) AS wish, count(*) AS texts FROM t),
        b AS (SELECT wish, greatest(1, (wish + {BLOCKS - 1}) // {BLOCKS}, 2 * ((wish + texts - 1) // texts)) AS block FROM z),
        s AS (SELECT source, share, CAST(sum(n) AS BIGINT) AS have, CAST(sum(n) * repeats AS BIGINT) AS most FROM t GROUP BY source, share, repeats),
        q AS (SELECT source, share, have, most, block, wish, unnest(range(0, least((most + block - 1) // block, (wish + block - 1) // block))) AS k FROM s, b),
        o AS (SELECT *, sum(least(block, most - k * block)) OVER (ORDER BY share / (2 * k + 1) DESC, source, k ROWS UNBOUNDED PRECEDING) - least(block, most - k * block) AS before FROM q)
        SELECT source, have, count(*) AS quota, least(count(*) * block, most) AS take FROM o WHERE before < wish GROUP BY source, have, most, block""",
    "p8_runs": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        e AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_passages),
        dg AS (SELECT doc_id, i - 1 AS pos, list_slice(w, i, i + {RUN_WORDS - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {RUN_WORDS - 2})) AS i FROM d)),
        eg AS (SELECT item_id, i - 1 AS ppos, list_slice(w, i, i + {RUN_WORDS - 1}) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {RUN_WORDS - 2})) AS i FROM e)),
        m AS (SELECT doc_id, item_id, pos, ppos, ppos - row_number() OVER (PARTITION BY doc_id, item_id, pos - ppos ORDER BY ppos) AS run FROM dg JOIN eg USING (g))
        SELECT doc_id, item_id, min(ppos) AS ppos, min(pos) AS pos, count(*) + {RUN_WORDS - 1} AS n_words FROM m GROUP BY doc_id, item_id, pos - ppos, run""",
    "p8_proximity": f"""
        WITH d AS (SELECT doc_id, i AS pos, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents))),
        f AS (SELECT word, count(*) AS df FROM d GROUP BY word),
        e AS (SELECT DISTINCT item_id, unnest({_WORDS.format("passage")}) AS word FROM eval_passages),
        k AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY df, word) AS k FROM e JOIN f USING (word)),
        c AS (SELECT * FROM k WHERE k <= {NEAR_TERMS} AND item_id IN (SELECT item_id FROM k WHERE k = {NEAR_TERMS})),
        p AS (SELECT item_id, doc_id, pos, {", ".join(f"max(CASE WHEN k = {k} THEN pos END) OVER w AS p{k}" for k in range(1, NEAR_TERMS + 1))} FROM c JOIN d USING (word) WINDOW w AS (PARTITION BY item_id, doc_id ORDER BY pos)),
        s AS (SELECT doc_id, item_id, pos - least({", ".join(f"p{k}" for k in range(1, NEAR_TERMS + 1))}) + 1 AS span FROM p WHERE {" AND ".join(f"p{k} IS NOT NULL" for k in range(1, NEAR_TERMS + 1))})
        SELECT doc_id, item_id, min(span) AS least_span FROM s GROUP BY doc_id, item_id HAVING min(span) <= {NEAR_SPAN}""",
}
