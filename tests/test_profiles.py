import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crumbtrail.functions.vectors import mean_pool
from crumbtrail.operators.profiles import build_profiles
from crumbtrail.operators.similarity import components, similar_pairs

MENTION = "id long, review_id long, business_id long, dish_name string, sentiment string, tags array<string>"


def test_ties_follow_the_members(spark):
    rows = [(1, 1, 1, "Birria Taco", "positive", ["rich"]), (2, 1, 1, "birria tacos", "negative", ["crispy"]), (3, 2, 1, "birria  taco", "neutral", ["juicy"])]
    vectors = spark.createDataFrame([(1, "birria taco", [1.0, 0.0]), (1, "birria tacos", [0.95, 0.1])], "business_id long, key string, embedding array<float>")
    (x,) = build_profiles(spark.createDataFrame(rows, MENTION), vectors).collect()
    assert (x["name"], x["mention_count"], x["positive_count"], x["negative_count"], x["tags"]) == ("Birria Taco", 3, 1, 1, ["rich", "juicy", "crispy"])
    assert abs(x["embedding"][0] - 0.975) < 1e-6


def test_no_vectors_no_mentions(spark):
    assert build_profiles(spark.createDataFrame([], MENTION)).count() == 0


VECTORS = {"a": [1.0, 0.0], "b": [0.9, 0.4359], "c": [0.62, 0.7846], "d": [0.0, 1.0], "z": [0.0, 0.0]}


def test_single_linkage(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in VECTORS.items()], "s long, k string, v array<double>")
    for block in (1, 500):
        edges = similar_pairs(df, "s", "k", "v", 0.87, block)
        assert {(r["a"], r["b"]) for r in edges.collect()} == {("a", "b"), ("b", "c")}
    got = {r["k"]: r["component"] for r in components(df, edges, "s", "k").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "z": "z"}
    pooled = mean_pool(df.where(F.col("k").isin("a", "b", "c")), ["s"], "v").first()["v"]
    assert [round(x, 5) for x in pooled] == [0.84, 0.40683]


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_components_of_chains_in_any_order(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(24)]
    edges = [(1, *sorted((names[i], names[i + 1]))) for i in range(23) if i != 11]
    r.shuffle(edges)
    v = spark.createDataFrame([(1, n) for n in names], "s long, k string")
    got = {x["k"]: x["component"] for x in components(v, spark.createDataFrame(edges, "s long, a string, b string"), "s", "k").collect()}
    assert got == {n: "n00" if i < 12 else "n12" for i, n in enumerate(names)}


def test_components_of_chains_and_hubs(spark, monkeypatch):
    import random

    from crumbtrail.operators import similarity

    monkeypatch.setattr(similarity, "FOREST_EDGES", 7)
    r = random.Random(4)
    edges = [(1, f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)] + [(1, "hub", f"h{k}") for k in range(80)] + [(2, "c000", "z"), (2, "a", "z"), (1, "x", "x"), (1, None, "c000")]
    r.shuffle(edges)
    pairs = spark.createDataFrame(edges, "s long, a string, b string").repartition(5)
    vertices = spark.createDataFrame([(s, v) for s, a, b in edges for v in (a, b) if v] + [(3, "alone")], "s long, k string")
    got = {(x["s"], x["k"]): x["component"] for x in similarity.components(vertices, pairs, "s", "k").collect()}
    for (s, k), c in got.items():
        assert c == (k if s == 3 or k == "x" else "a" if s == 2 else "c000" if k[0] == "c" else "h0")
    assert similarity.components(vertices, pairs.limit(0), "s", "k").where("component != k").count() == 0


def test_on_demand_states(spark):
    import datetime

    from crumbtrail.operators.on_demand import profiles_on_demand

    done = datetime.datetime(2024, 1, 1)
    businesses = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "id long")
    reviews = spark.createDataFrame([(10, 1, "new", None), (20, 2, "old", done), (30, 3, "old", done)], "id long, business_id long, review_text string, extracted_at timestamp")
    mentions = spark.createDataFrame([(1, 1, "Soup", "positive", ["hot"]), (2, 2, "Pie", "neutral", []), (3, 3, "Tea", "negative", [])], "id long, business_id long, dish_name string, sentiment string, tags array<string>")
    stored = spark.createDataFrame([(1, "soup", 9, 9, 0, []), (2, "Stored", 1, 1, 0, ["kept"])], "business_id long, name string, mention_count long, positive_count long, negative_count long, tags array<string>")

    def extracted(todo):
        assert [r["id"] for r in todo.collect()] == [10]
        return todo.selectExpr("id AS review_id", "business_id", "'soup' AS dish_name", "'negative' AS sentiment", "array('cold') AS tags", "0 AS position")

    out, new = profiles_on_demand(businesses, reviews, mentions, stored, extracted)
    assert {(r["business_id"], r["name"], r["mention_count"], r["negative_count"], r["state"]) for r in out.collect()} == {(1, "Soup", 2, 1, "extract"), (2, "Stored", 1, 0, "cached"), (3, "Tea", 1, 1, "aggregate")}
    assert new.count() == 1
