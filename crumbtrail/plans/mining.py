"""Queries and SQL of the review-mining operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail import providers
from crumbtrail.functions import scores
from crumbtrail.functions.categories import KEYWORDS, categories_of
from crumbtrail.functions.text import address_line, counted, highlight, normalize, tags_text
from crumbtrail.functions.vectors import mean_pool
from crumbtrail.operators import ingest, on_demand, pending, profiles, ranking, search, similarity, trim
from crumbtrail.sources.ndjson import business_condition
from crumbtrail.sources.sinks import as_json, listing_line, ranked_line
from crumbtrail.sources.tables import businesses, dishes, mentions, once, reviews, table

CITIES = "Thornby:TW, Fennick:QL, Mirefield:QL"
SIMILAR = 0.87
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it can be put in SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# SQL parts: each row id once, nulls as the tables say, names normalised.
_SPACE = r"[\s\x{A0}\x{1c}-\x{1f}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+"


def _norm(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_SPACE}', ' ', 'g')))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _categories(tags: str) -> str:
    cases = [f"CASE WHEN len(list_filter({tags}, lambda t: {' OR '.join(f'contains(lower(t), {w!r})' for w in words)})) > 0 THEN '{name}' END" for name, words in KEYWORDS.items()]
    return f"list_filter([{', '.join(cases)}], lambda c: c IS NOT NULL)"


_B = "b AS (SELECT DISTINCT * FROM businesses)"
_R = "r AS (SELECT DISTINCT * FROM reviews)"
_D = """d AS (SELECT id, business_id, name, coalesce(mention_count, 0) AS mention_count, coalesce(positive_count, 0) AS positive_count,
    coalesce(negative_count, 0) AS negative_count, coalesce(tags, []) AS tags, embedding, blurb FROM (SELECT DISTINCT * FROM dishes))"""
_E = "e AS (SELECT DISTINCT * FROM dish_extractions)"
_M = f"""m AS (SELECT id, review_id, business_id, {_norm("dish_name")} AS key, {_strip("dish_name")} AS surface, sentiment, list_filter(coalesce(tags, []), lambda t: t IS NOT NULL) AS tags
    FROM (SELECT DISTINCT * FROM dish_extractions) WHERE business_id IS NOT NULL AND sentiment IN ('positive', 'negative', 'neutral') AND {_norm("dish_name")} <> '')"""


#: The extraction table as it stood when only the reviews before this day were extracted: many businesses had none yet.
EARLY = "2014-06-01"
_E_EARLY = f"e AS (SELECT DISTINCT x.* FROM dish_extractions x JOIN reviews ON reviews.id = x.review_id WHERE review_date < DATE '{EARLY}')"


def _early(spark: SparkSession, folder: str) -> DataFrame:
    """Every business with any extraction is protected; taken early, so that the rules have something to remove."""
    old = table(spark, folder, "reviews").where(F.col("review_date") < F.lit(EARLY).cast("date")).select(F.col("id").alias("review_id"))
    return table(spark, folder, "dish_extractions").select("review_id", "business_id").join(old, "review_id", "left_semi")


def _ranked(source: str) -> str:
    return f"""f AS (SELECT * FROM {source} WHERE mention_count >= 3 AND positive_count + negative_count > 0),
    p AS (SELECT business_id, CAST(sum(positive_count) AS DOUBLE) / CAST(sum(positive_count + negative_count) AS DOUBLE) AS prior FROM f GROUP BY business_id),
    s AS (SELECT f.*, (v / (v + 5.0)) * (CAST(positive_count AS DOUBLE) / v) + (1.0 - v / (v + 5.0)) * prior AS score
        FROM (SELECT *, CAST(positive_count + negative_count AS DOUBLE) AS v FROM f) f JOIN p USING (business_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY score DESC, mention_count DESC, id) AS rank FROM s)"""


def _rank_out(df: DataFrame) -> DataFrame:
    return _long(df, "rank").select("business_id", "id", "name", "mention_count", "positive_count", "negative_count", F.round("score", 6).alias("score"), "rank")


_RANK_OUT = "SELECT business_id, id, name, mention_count, positive_count, negative_count, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 10"
_DISH_COLUMNS = ("business_id", "name", "mention_count", "positive_count", "negative_count", "tags")


# ---- ranking and categories ---------------------------------------------------------------------


@query(f"WITH {_D}, {_ranked('d')} {_RANK_OUT}")
def rank_dishes_topn(spark: SparkSession, folder: str) -> DataFrame:
    return _rank_out(ranking.rank_dishes(dishes(spark, folder, *_DISH_COLUMNS)))


@query(f"""WITH {_D}, c AS (SELECT * FROM d WHERE list_has_any({_categories('tags')}, ['spicy', 'sweet'])), {_ranked('c')} {_RANK_OUT}""")
def rank_after_category_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The pooled share is that of the filtered items, so the filter changes scores too."""
    return _rank_out(ranking.rank_dishes(ranking.filter_by_categories(dishes(spark, folder, *_DISH_COLUMNS), ["Spicy", "sweet"])))


@query(f"WITH {_D} SELECT id, array_to_string({_categories('tags')}, ',') AS categories FROM d")
def categorize(spark: SparkSession, folder: str) -> DataFrame:
    return dishes(spark, folder, "tags").select("id", F.array_join(categories_of(F.col("tags")), ",").alias("categories"))


_COUNTS = f"""c AS (SELECT business_id, id, unnest({_categories('tags')}) AS category FROM d),
    n AS (SELECT business_id, category, least(count(*), 10) AS n, min([id, list_position({list(KEYWORDS)!r}, category)]) AS spot FROM c GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY spot) AS position FROM n)"""


@query(f"WITH {_D}, {_COUNTS} SELECT business_id, category, CAST(n AS BIGINT) AS count, CAST(position AS BIGINT) AS position FROM o")
def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _long(ranking.category_counts(dishes(spark, folder, "business_id", "tags")), "count", "position")


@query(f"WITH {_D}, {_COUNTS} SELECT business_id, category, CASE WHEN n >= 10 THEN '10+' ELSE CAST(n AS VARCHAR) END AS label FROM o")
def chip_labels(spark: SparkSession, folder: str) -> DataFrame:
    return category_counts(spark, folder).select("business_id", "category", scores.chip(F.col("count")).alias("label"))


@query(f"""WITH {_D}, p AS (SELECT id, CASE WHEN positive_count + negative_count > 0 THEN CAST(floor(CAST(positive_count AS DOUBLE) * 100 / CAST(positive_count + negative_count AS DOUBLE) + 0.5) AS BIGINT) ELSE 50 END AS percent FROM d)
    SELECT id, percent, CASE WHEN percent >= 80 THEN 'positive' WHEN percent >= 40 THEN 'mixed' ELSE 'negative' END AS band FROM p""")
def sentiment_band(spark: SparkSession, folder: str) -> DataFrame:
    d = dishes(spark, folder, "positive_count", "negative_count").withColumn("percent", scores.percent_positive(F.col("positive_count"), F.col("negative_count")))
    return d.select("id", "percent", scores.band(F.col("percent")).alias("band"))


# ---- profiles -----------------------------------------------------------------------------------

_G = """g AS (SELECT business_id, key, count(*) AS mention_count, count(*) FILTER (sentiment = 'positive') AS positive_count, count(*) FILTER (sentiment = 'negative') AS negative_count, min(id) AS first_id FROM m GROUP BY 1, 2)"""
_EXACT = "c AS (SELECT business_id, key, key AS cluster, first_id, first_id AS cluster_first FROM g)"
_NAMES = """sf AS (SELECT business_id, key, surface, count(*) AS n, min(id) AS pos FROM m GROUP BY 1, 2, 3),
    st AS (SELECT business_id, cluster, surface, sum(n) AS n, min([first_id, pos]) AS spot FROM sf JOIN c USING (business_id, key) GROUP BY 1, 2, 3),
    nm AS (SELECT business_id, cluster, surface AS name FROM (SELECT *, row_number() OVER (PARTITION BY business_id, cluster ORDER BY n DESC, spot) AS k FROM st) WHERE k = 1)"""
_TAGS = """tl AS (SELECT business_id, key, id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS spot FROM m),
    tf AS (SELECT business_id, key, tag, count(*) AS n, min([id, spot]) AS pos FROM tl GROUP BY 1, 2, 3),
    tt AS (SELECT business_id, cluster, tag, sum(n) AS n, min([first_id, pos[1], pos[2]]) AS pos FROM tf JOIN c USING (business_id, key) GROUP BY 1, 2, 3),
    tg AS (SELECT business_id, cluster, string_agg(tag, '|' ORDER BY k) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY business_id, cluster ORDER BY n DESC, pos) AS k FROM tt) WHERE k <= 5 GROUP BY 1, 2)"""


@query(f"WITH {_M}, {_G} SELECT business_id, key, mention_count, positive_count, negative_count FROM g")
def group_normalized_names(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.group_names(mentions(spark, folder)).drop("first_id")


@query(f"WITH {_M}, {_G}, {_EXACT}, {_NAMES} SELECT business_id, cluster AS key, name FROM nm")
def canonical_name(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.canonical_names(mentions(spark, folder)).withColumnRenamed("cluster", "key")


@query(f"WITH {_M}, {_G}, {_EXACT}, {_TAGS} SELECT business_id, cluster AS key, tags FROM tg")
def top_tags(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.top_tags(mentions(spark, folder)).select("business_id", F.col("cluster").alias("key"), F.array_join("tags", "|").alias("tags"))


_V = f"v AS (SELECT business_id, {_norm('name')} AS key, CAST(min_by(embedding, id) AS DOUBLE[]) AS x FROM d WHERE embedding IS NOT NULL GROUP BY 1, 2)"


def _pairs(source: str, key: str) -> str:
    return f"SELECT p.business_id, p.{key} AS a, q.{key} AS b, list_cosine_similarity(p.x, q.x) AS s FROM {source} p JOIN {source} q ON p.business_id = q.business_id AND p.{key} < q.{key}"


@query(f"""WITH {_D}, v AS (SELECT id, business_id, CAST(embedding AS DOUBLE[]) AS x FROM d WHERE embedding IS NOT NULL), s AS ({_pairs('v', 'id')})
    SELECT business_id, a, b, round(s, 6) AS similarity FROM s WHERE s >= {SIMILAR} AND NOT isnan(s)""")
def similar_pairs(spark: SparkSession, folder: str) -> DataFrame:
    d = dishes(spark, folder, "business_id", "embedding")
    return similarity.similar_pairs(d, "business_id", "id", "embedding", SIMILAR).withColumn("similarity", F.round("similarity", 6))


_CLOSURE = f"""v AS (SELECT id, business_id, CAST(embedding AS DOUBLE[]) AS x FROM d WHERE embedding IS NOT NULL), s AS ({_pairs('v', 'id')}),
    u AS (SELECT a, b FROM s WHERE s >= {SIMILAR} AND NOT isnan(s) UNION SELECT b, a FROM s WHERE s >= {SIMILAR} AND NOT isnan(s)),
    h(id, reached) AS (SELECT id, id FROM d UNION SELECT h.id, u.b FROM h JOIN u ON h.reached = u.a), k AS (SELECT id, min(reached) AS component FROM h GROUP BY id)"""


def _components(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = dishes(spark, folder, "business_id", "embedding")
    edges = similarity.similar_pairs(d, "business_id", "id", "embedding", SIMILAR)
    return d, similarity.components(d, edges, "business_id", "id")


@query(f"WITH RECURSIVE {_D}, {_CLOSURE} SELECT business_id, id, component FROM d JOIN k USING (id)")
def similarity_components(spark: SparkSession, folder: str) -> DataFrame:
    return _components(spark, folder)[1]


@query(f"""WITH RECURSIVE {_D}, {_CLOSURE}, l AS (SELECT component, unnest(range(0, len(x))) AS dim, unnest(x) AS y FROM k JOIN v USING (id))
    SELECT component, CAST(dim AS BIGINT) AS dim, round(avg(y), 5) AS value FROM l GROUP BY 1, 2""")
def mean_pool_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    d, c = _components(spark, folder)
    pooled = mean_pool(d.join(c.select("id", "component"), "id"), ["component"], "embedding")
    return _long(pooled.select("component", F.posexplode("embedding").alias("dim", "value")), "dim").withColumn("value", F.round("value", 5))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    d = dishes(spark, folder, "business_id", "name", "embedding").where(F.col("embedding").isNotNull())
    return d.groupBy("business_id", normalize(F.col("name")).alias("key")).agg(F.min_by("embedding", "id").alias("embedding"))


@query(f"""WITH RECURSIVE {_D}, {_M}, {_G}, {_V}, w AS (SELECT g.business_id, g.key, g.first_id, v.x FROM g LEFT JOIN v USING (business_id, key)),
    s AS ({_pairs('w', 'key')}), u AS (SELECT business_id, a, b FROM s WHERE s >= {SIMILAR} AND NOT isnan(s) UNION SELECT business_id, b, a FROM s WHERE s >= {SIMILAR} AND NOT isnan(s)),
    h(business_id, key, reached) AS (SELECT business_id, key, key FROM g UNION SELECT h.business_id, h.key, u.b FROM h JOIN u ON h.business_id = u.business_id AND h.reached = u.a),
    k AS (SELECT business_id, key, min(reached) AS component FROM h GROUP BY 1, 2),
    c AS (SELECT k.business_id, k.key, first_id, first_value(k.key) OVER (PARTITION BY k.business_id, component ORDER BY first_id) AS cluster, min(first_id) OVER (PARTITION BY k.business_id, component) AS cluster_first FROM k JOIN g USING (business_id, key)),
    {_NAMES}, {_TAGS},
    t AS (SELECT business_id, cluster, sum(mention_count) AS mention_count, sum(positive_count) AS positive_count, sum(negative_count) AS negative_count FROM g JOIN c USING (business_id, key) GROUP BY 1, 2)
    SELECT t.business_id, name, CAST(mention_count AS BIGINT) AS mention_count, CAST(positive_count AS BIGINT) AS positive_count, CAST(negative_count AS BIGINT) AS negative_count, coalesce(tags, '') AS tags
    FROM t JOIN nm USING (business_id, cluster) LEFT JOIN tg USING (business_id, cluster)""")
def dish_profiles(spark: SparkSession, folder: str) -> DataFrame:
    built = profiles.build_profiles(mentions(spark, folder), _vectors(spark, folder), SIMILAR)
    return built.select("business_id", "name", "mention_count", "positive_count", "negative_count", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {_D}, {_B} SELECT business_id, d.name, mention_count, positive_count, negative_count, array_to_string(tags, '|') AS tags FROM d WHERE business_id IN (SELECT id FROM b)")
def profile_cache_read(spark: SparkSession, folder: str) -> DataFrame:
    """The stored profiles of all businesses; vectors and blurbs are not read."""
    d = dishes(spark, folder, *_DISH_COLUMNS).join(businesses(spark, folder).select(F.col("id").alias("business_id")), "business_id", "left_semi")
    return d.select(*_DISH_COLUMNS[:5], F.array_join("tags", "|").alias("tags"))


@query(f"WITH {_D} SELECT business_id, id, CAST(row_number() OVER (PARTITION BY business_id ORDER BY mention_count DESC, id) AS BIGINT) AS position FROM d")
def listing_by_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """All stored dishes in listing order: most mentioned first."""
    return _long(search.listing(dishes(spark, folder, "business_id", "mention_count")), "position").select("business_id", "id", "position")


_BLURB = "name || ': praised by ' || positive_count || ' of ' || (positive_count + negative_count) || ' voters; ' || CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'no tags yet' END || '.'"


@query(f"""WITH {_D}, {_ranked('d')}, h AS (SELECT business_id, name, mention_count, positive_count, negative_count, tags, min(blurb) AS held FROM d WHERE blurb <> '' GROUP BY ALL)
    SELECT business_id, id, coalesce(held, {_BLURB}) AS blurb FROM k LEFT JOIN h USING (business_id, name, mention_count, positive_count, negative_count, tags) WHERE rank <= 10""")
def blurb_cache_join(spark: SparkSession, folder: str) -> DataFrame:
    """Blurbs of the ranked items: the stored one of the same counts and tags, else a new one for the ten best only."""
    d = dishes(spark, folder, *_DISH_COLUMNS, "blurb")
    return providers.with_blurbs(ranking.rank_dishes(d), providers.blurb_cache(d))[0].select("business_id", "id", "blurb")


@query(f"""WITH {_D}, {_ranked('d')}, h AS (SELECT DISTINCT business_id, name, mention_count + 1 AS mention_count, positive_count + 1 AS positive_count, negative_count, tags FROM d WHERE blurb <> '')
    SELECT k.business_id, k.id FROM k LEFT JOIN h USING (business_id, name, mention_count, positive_count, negative_count, tags) WHERE rank <= 10 AND h.name IS NULL""")
def blurbs_to_write(spark: SparkSession, folder: str) -> DataFrame:
    """The ranked items without a valid blurb where each stored one was written before the last positive mention came in."""
    d = dishes(spark, folder, *_DISH_COLUMNS, "blurb")
    older = d.withColumns({c: F.col(c) + 1 for c in ("mention_count", "positive_count")})
    new = providers.with_blurbs(ranking.rank_dishes(d), providers.blurb_cache(older))[1]
    return ranking.rank_dishes(d).withColumn("facts", providers.facts()).join(new, ["business_id", "name", "facts"], "left_semi").select("business_id", "id")


@query(f"""WITH {_D}, {_B}, {_ranked('d')} SELECT k.id, 'Write one sentence on ' || k.name || ' at ' || b.name || '. It came up ' || mention_count || ' times; ' || positive_count || ' liked it, ' || negative_count || ' did not. Guests wrote: '
    || CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'nothing in particular' END || '.' AS prompt FROM k JOIN b ON b.id = k.business_id WHERE rank <= 10""")
def blurb_prompts(spark: SparkSession, folder: str) -> DataFrame:
    named = businesses(spark, folder).select(F.col("id").alias("business_id"), F.col("name").alias("business_name"))
    return ranking.rank_dishes(dishes(spark, folder, *_DISH_COLUMNS)).join(named, "business_id").select("id", providers.prompt().alias("prompt"))


@query(f"""WITH {_D} SELECT id, name || ': ' || mention_count || ' mention(s) (' || positive_count || ' positive, ' || negative_count || ' negative) — tags: ' || CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE '—' END AS line FROM d""")
def listing_lines(spark: SparkSession, folder: str) -> DataFrame:
    d = dishes(spark, folder, *_DISH_COLUMNS)
    return d.select("id", listing_line(*[F.col(c) for c in _DISH_COLUMNS[1:]]).alias("line"))


@query(f"""WITH {_D}, {_ranked('d')} SELECT id, rank || '. ' || name || '  (' || positive_count || '/' || (positive_count + negative_count) || ' positive, ' || mention_count || CASE WHEN mention_count = 1 THEN ' mention)' ELSE ' mentions)' END AS line FROM k WHERE rank <= 10""")
def ranked_lines(spark: SparkSession, folder: str) -> DataFrame:
    k = ranking.rank_dishes(dishes(spark, folder, *_DISH_COLUMNS))
    return k.select("id", ranked_line(F.col("rank"), F.col("name"), F.col("positive_count"), F.col("negative_count"), F.col("mention_count")).alias("line"))


@query(f"""WITH {_D}, {_ranked('d')} SELECT '{{"rank":' || rank || ',"name":' || to_json(name) || ',"mention_count":' || mention_count || ',"positive_count":' || positive_count || ',"negative_count":' || negative_count || ',"tags":' || to_json(tags) || '}}' AS value FROM k WHERE rank <= 10""")
def recommendations_json(spark: SparkSession, folder: str) -> DataFrame:
    return as_json(ranking.rank_dishes(dishes(spark, folder, *_DISH_COLUMNS)).select("rank", *_DISH_COLUMNS[1:]))


# ---- search -------------------------------------------------------------------------------------

_LABEL = "CASE WHEN concat_ws(', ', nullif(address, ''), nullif(city, ''), nullif(state, ''), nullif(postal_code, '')) <> '' THEN name || ' — ' || concat_ws(', ', nullif(address, ''), nullif(city, ''), nullif(state, ''), nullif(postal_code, '')) ELSE name END"


@query(f"WITH {_B} SELECT id AS business_id, name, address, city, state, postal_code, {_LABEL} AS label FROM b WHERE name ILIKE '%the%'")
def search_business(spark: SparkSession, folder: str) -> DataFrame:
    return search.matches(search.find_businesses(businesses(spark, folder), "the"))


@query(f"WITH {_B}, f AS (SELECT * FROM b WHERE name ILIKE '%e%') SELECT id, name, greatest((SELECT count(*) FROM f) - 20, 0) AS overflow FROM f ORDER BY name, id LIMIT 20")
def search_overflow(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty matches: a top-k report."""
    return _long(search.first_matches(search.find_businesses(businesses(spark, folder), "e")).select("id", "name", "overflow"), "overflow")


@query(f"WITH {_B} SELECT id, name FROM b WHERE id = 1")
def business_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return search.find_businesses(businesses(spark, folder), business_id=1).select("id", "name")


@query(f"WITH {_B} SELECT id, {_LABEL} AS label FROM b")
def address_lines(spark: SparkSession, folder: str) -> DataFrame:
    return businesses(spark, folder).select("id", address_line(F.col("name"), F.col("address"), F.col("city"), F.col("state"), F.col("postal_code")).alias("label"))


_AT = "instr(lower(name), 'an')"


@query(f"""WITH {_D} SELECT id, CASE WHEN {_AT} > 0 THEN substring(name, 1, {_AT} - 1) ELSE name END AS before, CASE WHEN {_AT} > 0 THEN substring(name, {_AT}, 2) ELSE '' END AS hit,
    CASE WHEN {_AT} > 0 THEN substring(name, {_AT} + 2) ELSE '' END AS after FROM d""")
def highlight_match(spark: SparkSession, folder: str) -> DataFrame:
    return dishes(spark, folder, "name").select("id", highlight(F.col("name"), "an").alias("h")).select("id", "h.*")


@query(f"WITH {_D} SELECT id, mention_count || CASE WHEN mention_count = 1 THEN ' mention' ELSE ' mentions' END AS counted, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE '—' END AS tags FROM d")
def count_labels(spark: SparkSession, folder: str) -> DataFrame:
    return dishes(spark, folder, "mention_count", "tags").select("id", counted(F.col("mention_count"), "mention").alias("counted"), tags_text(F.col("tags"), "—").alias("tags"))


# ---- pending reviews ----------------------------------------------------------------------------

_LONGEST = "row_number() OVER (PARTITION BY business_id ORDER BY length(review_text) DESC, id)"


@query(f"WITH {_R} SELECT id, business_id, review_text FROM r WHERE extracted_at IS NULL")
def pending_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return pending.work_list(reviews(spark, folder), ordered=False)


@query(f"WITH {_R} SELECT id, business_id, review_text FROM (SELECT *, {_LONGEST} AS k FROM r WHERE extracted_at IS NULL) WHERE k <= 3")
def longest_pending_per_business(spark: SparkSession, folder: str) -> DataFrame:
    return pending.work_list(reviews(spark, folder), max_per_business=3, ordered=False)


@query(f"WITH {_R}, {_E} SELECT id, business_id FROM r WHERE id NOT IN (SELECT review_id FROM e WHERE review_id IS NOT NULL) AND extracted_at IS NULL")
def pending_by_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Pending reviews that a ledger of the reviews with mentions doesn't name."""
    ledger = table(spark, folder, "dish_extractions").select("review_id").where("review_id IS NOT NULL").distinct()
    return pending.pending(reviews(spark, folder, "business_id", "extracted_at"), ledger).select("id", "business_id")


@query(f"""WITH {_R}, {_E}, n AS (SELECT review_id, count(*) AS n FROM e GROUP BY 1),
    c AS (SELECT CAST(length(review_text) >= 200 AS INT) + CAST(length(review_text) >= 500 AS INT) + CAST(length(review_text) >= 900 AS INT) AS bucket, coalesce(n, 0) AS n FROM r LEFT JOIN n ON r.id = n.review_id WHERE extracted_at IS NOT NULL)
    SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n_reviews, round(avg(CAST(n = 0 AS DOUBLE)), 6) AS zero_rate, round(avg(CAST(n AS DOUBLE)), 6) AS mean_mentions FROM c GROUP BY bucket""")
def length_bucket_study(spark: SparkSession, folder: str) -> DataFrame:
    found = once(table(spark, folder, "dish_extractions").select("id", "review_id"))
    out = pending.length_study(reviews(spark, folder, "review_text", "extracted_at"), found)
    return _long(out, "bucket").withColumns({c: F.round(c, 6) for c in ("zero_rate", "mean_mentions")})


def _in(words: frozenset) -> str:
    return f"w IN ({', '.join(repr(w) for w in sorted(words))})"


# Mentions that the pattern finds in the reviews of q: x.
_CLAUSE = providers._DISH_CLAUSE.replace("'", "''")
_X = f"""x0 AS (SELECT id, business_id, unnest(regexp_extract_all(lower(coalesce(review_text, '')), '{_CLAUSE}', 1)) AS dish, unnest(regexp_extract_all(lower(coalesce(review_text, '')), '{_CLAUSE}', 2)) AS rest,
        unnest(range(0, len(regexp_extract_all(lower(coalesce(review_text, '')), '{_CLAUSE}', 0)))) AS position FROM q),
    x1 AS (SELECT *, list_filter(regexp_extract_all(rest, '[a-z]+'), lambda w: {_in(providers.GOOD)}) AS good, list_filter(regexp_extract_all(rest, '[a-z]+'), lambda w: {_in(providers.BAD)}) AS bad FROM x0),
    x AS (SELECT id AS review_id, business_id, dish, position, CASE WHEN len(good) > len(bad) THEN 'positive' WHEN len(bad) > 0 THEN 'negative' ELSE 'neutral' END AS sentiment, list_concat(good, bad)[1:3] AS tags FROM x1)"""
_Q = "q AS (SELECT id, business_id, review_text FROM r WHERE extracted_at IS NULL)"


def _extracted(spark: SparkSession, folder: str) -> DataFrame:
    return providers.extract_by_pattern(pending.work_list(reviews(spark, folder, "business_id", "review_text", "extracted_at"), ordered=False))


@query(f"WITH {_R}, {_Q}, {_X} SELECT review_id, business_id, dish AS dish_name, sentiment, array_to_string(tags, '|') AS tags, position FROM x")
def extract_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by pattern in all pending reviews."""
    found = providers.mention_rows(_extracted(spark, folder))
    return _long(found.withColumn("tags", F.array_join("tags", "|")), "position")


@query(f"WITH {_R}, {_Q}, {_X} SELECT (SELECT count(*) FROM q) AS processed, (SELECT count(*) FROM x) AS mentions, 0 AS failed")
def extraction_counts(spark: SparkSession, folder: str) -> DataFrame:
    return providers.run_counts(_extracted(spark, folder))


@query()
def extract_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by an extractor that is called per text, as an external model would be; here the word list."""
    return providers.mention_rows(providers.extract(pending.work_list(reviews(spark, folder, "business_id", "review_text", "extracted_at"), ordered=False), concurrency=1))


@query()
def embed_names(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all normalised names, each distinct one embedded once."""
    names = mentions(spark, folder).select(normalize(F.col("dish_name")).alias("key")).distinct()
    return providers.embed(names, "key", providers.hashing_embedder(16))


# ---- on demand ----------------------------------------------------------------------------------

#: Reviews from this day on count as delivered since the last run; what was stored before has the businesses extracted early.
SINCE = "2023-06-01"
_STATES = f"""{_B}, {_R}, {_D}, h AS (SELECT DISTINCT x.business_id FROM dish_extractions x JOIN reviews v ON v.id = x.review_id WHERE review_date < DATE '{EARLY}' AND x.business_id IS NOT NULL),
    q AS (SELECT id, business_id, review_text FROM r WHERE extracted_at IS NULL AND review_date >= DATE '{SINCE}'),
    t AS (SELECT id AS business_id, CASE WHEN id IN (SELECT business_id FROM q WHERE business_id IS NOT NULL) THEN 'extract' WHEN id IN (SELECT business_id FROM d WHERE business_id IN (SELECT * FROM h)) THEN 'cached' ELSE 'aggregate' END AS state FROM b)"""


def _delivered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Businesses, the reviews delivered since the last run, and the profiles stored before."""
    since = table(spark, folder, "reviews").where(F.col("review_date") >= F.lit(SINCE).cast("date")).select("id", "business_id", "review_text", "extracted_at")
    stored = dishes(spark, folder, *_DISH_COLUMNS).join(_early(spark, folder).select("business_id").distinct(), "business_id", "left_semi")
    return businesses(spark, folder), once(since), stored


@query(f"WITH {_STATES} SELECT business_id, state FROM t")
def business_states(spark: SparkSession, folder: str) -> DataFrame:
    return on_demand.states(*_delivered(spark, folder))


@query(f"""WITH {_STATES}, {_X}, {_M.replace("m AS (", "m0 AS (", 1)},
    m AS (SELECT id, business_id, key, surface, sentiment, tags FROM m0 WHERE business_id IN (SELECT business_id FROM t WHERE state <> 'cached')
        UNION ALL SELECT (SELECT max(id) FROM m0) + 1 + review_id * 1048576 + position, business_id, {_norm("dish")}, {_strip("dish")}, sentiment, tags FROM x WHERE business_id IN (SELECT business_id FROM t WHERE state = 'extract')),
    {_G}, {_EXACT}, {_NAMES}, {_TAGS}
    SELECT g.business_id, name, mention_count, positive_count, negative_count, coalesce(tags, '') AS tags, state FROM g JOIN nm ON nm.business_id = g.business_id AND nm.cluster = key LEFT JOIN tg ON tg.business_id = g.business_id AND tg.cluster = key JOIN t ON t.business_id = g.business_id
    UNION ALL SELECT business_id, name, mention_count, positive_count, negative_count, array_to_string(tags, '|'), state FROM d JOIN t USING (business_id) WHERE state = 'cached'""")
def profiles_on_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of all businesses: built where reviews wait or nothing is stored, read where all is done. Names are grouped exactly."""
    there, since, stored = _delivered(spark, folder)
    out = on_demand.profiles_on_demand(there, since, mentions(spark, folder), stored, lambda todo: providers.mention_rows(providers.extract_by_pattern(todo)))[0]
    return out.withColumn("tags", F.array_join("tags", "|"))


# ---- maintenance --------------------------------------------------------------------------------


@query(f"""WITH {_R}, t AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY extracted_at IS NOT NULL DESC, length(review_text) DESC, id) AS k FROM r)
    SELECT id, business_id FROM t WHERE k <= 30 OR extracted_at IS NOT NULL""")
def cap_reviews(spark: SparkSession, folder: str) -> DataFrame:
    narrow = reviews(spark, folder, "business_id", "review_text", "extracted_at")
    return trim.cap_reviews(narrow, 30).select("id", "business_id")


_HELD = "id IN (SELECT business_id FROM e WHERE business_id IS NOT NULL)"
_IN_CITIES = " OR ".join(f"(lower(city) = '{c.lower()}' AND lower(state) = '{s.lower()}')" for c, s in trim.parse_cities(CITIES))


@query(f"WITH {_B}, {_E_EARLY} SELECT id, name FROM b WHERE {_IN_CITIES} OR {_HELD}")
def prune_cities(spark: SparkSession, folder: str) -> DataFrame:
    return trim.keep_businesses(businesses(spark, folder), trim.in_cities(trim.parse_cities(CITIES)), _early(spark, folder)).select("id", "name")


@query(f"WITH {_B}, {_E_EARLY}, {_R}, k AS (SELECT id FROM b WHERE {_IN_CITIES} OR {_HELD}) SELECT id FROM r WHERE business_id IN (SELECT id FROM k)")
def prune_cities_reviews(spark: SparkSession, folder: str) -> DataFrame:
    kept = trim.keep_businesses(businesses(spark, folder), trim.in_cities(trim.parse_cities(CITIES)), _early(spark, folder))
    return trim.reviews_of(reviews(spark, folder, "business_id"), kept).select("id")


@query(f"WITH {_B}, {_E_EARLY} SELECT id, name FROM b WHERE yelp_stars IS NULL OR yelp_stars >= 3.5 OR {_HELD}")
def prune_low_rated(spark: SparkSession, folder: str) -> DataFrame:
    return trim.keep_businesses(businesses(spark, folder), trim.rated_at_least(3.5), _early(spark, folder)).select("id", "name")


@query(f"""WITH {_B}, {_E_EARLY}, k AS (SELECT id FROM b WHERE yelp_stars IS NULL OR yelp_stars >= 3.5 OR {_HELD})
    SELECT count(*) AS n_before, (SELECT count(*) FROM k) AS n_after, count(*) - (SELECT count(*) FROM k) AS n_removed FROM b""")
def rows_removed(spark: SparkSession, folder: str) -> DataFrame:
    all_ = businesses(spark, folder)
    return trim.removed(all_, trim.keep_businesses(all_, trim.rated_at_least(3.5), _early(spark, folder)))


_THERE = "business_id IN (SELECT id FROM b) AND review_id IN (SELECT id FROM r)"


@query(f"WITH {_B}, {_R}, {_E} SELECT id FROM e WHERE {_THERE}")
def whole_extractions(spark: SparkSession, folder: str) -> DataFrame:
    e = once(table(spark, folder, "dish_extractions").select("id", "business_id", "review_id"))
    return trim.whole_extractions(e, businesses(spark, folder).select("id"), reviews(spark, folder)).select("id")


@query(f"WITH {_B}, {_R}, {_E} SELECT id FROM e WHERE NOT coalesce(business_id IN (SELECT id FROM b), false) OR NOT coalesce(review_id IN (SELECT id FROM r), false)")
def orphan_extractions(spark: SparkSession, folder: str) -> DataFrame:
    e = once(table(spark, folder, "dish_extractions").select("id", "business_id", "review_id"))
    return e.join(trim.whole_extractions(e, businesses(spark, folder).select("id"), reviews(spark, folder)).select("id"), "id", "left_anti").select("id")


@query(f"WITH {_B}, {_D}, k AS (SELECT id FROM b WHERE yelp_stars >= 3.5) SELECT id FROM d WHERE business_id NOT IN (SELECT id FROM k)")
def orphan_dishes(spark: SparkSession, folder: str) -> DataFrame:
    """Dishes of businesses that a rating floor without exceptions would remove."""
    return ingest.orphans(dishes(spark, folder, "business_id"), businesses(spark, folder).where("yelp_stars >= 3.5"), "business_id").select("id")


@query(f"""WITH {_B}, {_R}, {_E}, {_D} SELECT 'reviews' AS child, count(*) AS n FROM r WHERE NOT coalesce(business_id IN (SELECT id FROM b), false)
    UNION ALL SELECT 'dishes', count(*) FROM d WHERE NOT coalesce(business_id IN (SELECT id FROM b), false) UNION ALL SELECT 'dish_extractions', count(*) FROM e WHERE NOT coalesce(business_id IN (SELECT id FROM b), false)""")
def referential_integrity(spark: SparkSession, folder: str) -> DataFrame:
    there = businesses(spark, folder)
    out = None
    for name in ("reviews", "dishes", "dish_extractions"):
        part = ingest.orphans(once(table(spark, folder, name).select("id", "business_id")), there, "business_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_R} SELECT yelp_review_id, business_id AS source, CAST(stars AS BIGINT) AS stars, review_date, length(review_text) AS n FROM r WHERE yelp_review_id IS NOT NULL")
def incoming_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """All reviews as a delivery has them, numbers as doubles and dates as text with a time, brought to the table's columns."""
    r = reviews(spark, folder, "business_id", "yelp_review_id", "stars", "review_text", "review_date").where("yelp_review_id IS NOT NULL")
    raw = r.select(F.col("yelp_review_id").alias("review_id"), "business_id", F.col("review_text").alias("text"), F.col("stars").cast("double").alias("stars"), F.concat(F.col("review_date").cast("string"), F.lit(" 12:30:00")).alias("date"))
    out = ingest.incoming_reviews(raw)
    return out.select("yelp_review_id", F.col("business_id").alias("source"), F.col("stars").cast("long").alias("stars"), "review_date", F.length("review_text").cast("long").alias("n"))


@query("SELECT coalesce(max(id), 1) AS last_id FROM reviews")
def last_review_id(spark: SparkSession, folder: str) -> DataFrame:
    return trim.next_id(table(spark, folder, "reviews"))


# ---- ingest -------------------------------------------------------------------------------------


def _strip_sql(c: str) -> str:
    return _strip(f"coalesce({c}, '')")


_WANTED = f"lower({_strip_sql('city')}) = 'thornby' AND contains(lower(coalesce(array_to_string(categories, ', '), '')), 'restaurants')"


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    b = businesses(spark, folder).withColumn("categories", F.array_join("categories", ", "))
    return b.where(business_condition(city="Thornby", category="Restaurants", row=""))


@query(f"WITH {_B} SELECT id, name FROM b WHERE {_WANTED}")
def filter_businesses(spark: SparkSession, folder: str) -> DataFrame:
    return _wanted(spark, folder).select("id", "name")


@query(f"WITH {_B} SELECT r.id, r.business_id FROM reviews r WHERE business_id IN (SELECT id FROM b WHERE {_WANTED})")
def filter_reviews_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated rows stay, as a filter of lines keeps them."""
    ids = _wanted(spark, folder).select(F.col("id").alias("business_id"))
    return table(spark, folder, "reviews").select("id", "business_id").join(ids, "business_id", "left_semi").select("id", "business_id")


@query(f"""WITH {_B}, {_R}, n AS (SELECT r.yelp_review_id, b.yelp_business_id AS source FROM r JOIN b ON b.id = r.business_id)
    SELECT n.yelp_review_id, b.id AS business_id FROM n JOIN b ON b.yelp_business_id = n.source WHERE b.yelp_stars >= 3.5""")
def load_reviews_join(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews under their source's id, loaded with a delivery of the better rated businesses only."""
    b = businesses(spark, folder)
    named = reviews(spark, folder, "business_id", "yelp_review_id").join(b.select(F.col("id").alias("business_id"), F.col("yelp_business_id").alias("source")), "business_id")
    delivered = named.select("yelp_review_id", F.col("source").alias("business_id"))
    return ingest.with_business(delivered, b.where("yelp_stars >= 3.5")).select("yelp_review_id", "business_id")


@query(f"""WITH {_B}, x AS (SELECT yelp_business_id FROM b WHERE yelp_stars >= 4) SELECT yelp_business_id, CASE WHEN yelp_business_id IN (SELECT * FROM x) THEN upper(name) ELSE name END AS name,
    CASE WHEN yelp_business_id IN (SELECT * FROM x) THEN NULL ELSE address END AS address, city, postal_code, array_to_string(categories, '|') AS categories FROM b""")
def upsert_businesses(spark: SparkSession, folder: str) -> DataFrame:
    """A second delivery renames and moves the businesses of four stars and more: the new address counts, though null; the new city doesn't."""
    b = businesses(spark, folder)
    again = b.where("yelp_stars >= 4").withColumns({"name": F.upper("name"), "address": F.lit(None).cast("string"), "city": F.lit("elsewhere")})
    out = ingest.upsert(b, again, "yelp_business_id", "id", ingest.UPDATED, ingest.KEPT)
    return out.select("yelp_business_id", "name", "address", "city", "postal_code", F.array_join("categories", "|").alias("categories"))


@query(f"WITH {_R} SELECT yelp_review_id, min(id) AS id FROM r WHERE yelp_review_id NOT IN (SELECT yelp_review_id FROM r WHERE extracted_at IS NOT NULL) GROUP BY 1")
def insert_ignore_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """All reviews delivered again to a table that has the extracted ones."""
    r = table(spark, folder, "reviews").select("id", "yelp_review_id", "extracted_at")
    return ingest.insert_ignore(r.where("extracted_at IS NOT NULL"), r, "yelp_review_id", "id").select("yelp_review_id", "id")


@query(f"WITH {_R} SELECT (SELECT count(*) FROM reviews) AS attempted, (SELECT count(DISTINCT yelp_review_id) FROM r WHERE yelp_review_id NOT IN (SELECT yelp_review_id FROM r WHERE extracted_at IS NOT NULL)) AS inserted")
def load_counts(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "reviews").select("id", "yelp_review_id", "extracted_at")
    return ingest.load_counts(r, ingest.insert_ignore(r.where("extracted_at IS NOT NULL"), r, "yelp_review_id", "id"))
