import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crumbtrail.functions import scores
from crumbtrail.functions.categories import categories_of
from crumbtrail.operators.ranking import category_counts, filter_by_categories, rank_dishes

ROWS = [("chicken", 14, 12, 2), ("lucky", 3, 3, 0), ("garlic naan", 6, 5, 0), ("naan", 4, 4, 0), ("bland", 8, 2, 5), ("rare", 2, 2, 0), ("neutral", 5, 0, 0)]
SCHEMA = "id long, business_id long, name string, mention_count long, positive_count long, negative_count long, tags array<string>"


def profiles(spark, rows=ROWS, tags=None):
    return spark.createDataFrame([(i, 1, *r, (tags or {}).get(r[0], [])) for i, r in enumerate(rows)], SCHEMA)


def test_ranking_golden(spark):
    got = [(r["name"], round(r["score"], 6)) for r in rank_dishes(profiles(spark)).orderBy("rank").collect()]
    assert got == [("garlic naan", 0.893939), ("naan", 0.882155), ("lucky", 0.867424), ("chicken", 0.838915), ("bland", 0.494949)]


def test_filter_changes_the_prior(spark):
    some = filter_by_categories(profiles(spark, tags={"chicken": ["Fiery"], "bland": ["spicy"]}), ["SPICY"])
    got = {r["name"]: round(r["score"], 6) for r in rank_dishes(some).collect()}
    assert got == {"chicken": 0.807018, "bland": 0.444444}


def test_no_selection_keeps_all_and_unknown_keeps_none(spark):
    assert filter_by_categories(profiles(spark), []).count() == 7
    assert filter_by_categories(profiles(spark), ["", ""]).count() == 0


@pytest.mark.parametrize("bad", [{"top_n": 0}, {"top_n": 11}, {"min_mentions": 0}, {"confidence": -1}])
def test_parameters_are_checked(spark, bad):
    with pytest.raises(ValueError):
        rank_dishes(profiles(spark), **bad)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(3, 50), st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=8), st.sampled_from([0.0, 0.5, 5.0, 100.0]))
def test_score_lies_between_share_and_prior(spark, rows, confidence):
    fit = [r for r in rows if r[1] + r[2]]
    prior = sum(r[1] for r in fit) / max(1, sum(r[1] + r[2] for r in fit))
    for x in rank_dishes(profiles(spark, [(str(i), *r) for i, r in enumerate(rows)]), None, 3, confidence).collect():
        share = x["positive_count"] / (x["positive_count"] + x["negative_count"])
        assert min(share, prior) - 1e-9 <= x["score"] <= max(share, prior) + 1e-9
        assert confidence or abs(x["score"] - share) < 1e-9


@pytest.mark.parametrize(
    ("tags", "want"),
    [(["too sweet", "Flavorful"], ["sweet"]), (["fiery", "filling"], ["spicy", "hearty"]), (["fresh chili"], ["spicy", "light"]), (["not spicy enough"], ["spicy"]), (["whole wheat"], ["spicy"]), (["delightful"], ["light"]), ([], []), (None, []), ([None, "honey"], ["sweet"])],
)
def test_categories(spark, tags, want):
    assert spark.createDataFrame([(tags,)], "tags array<string>").select(categories_of(F.col("tags")).alias("c")).first()["c"] == want


def test_category_counts_are_capped_and_ordered(spark):
    rows = [(f"d{i}", 1, 0, 0) for i in range(12)]
    got = category_counts(profiles(spark, rows, {f"d{i}": ["sweet"] if i else ["light", "spicy"] for i in range(12)})).orderBy("position").collect()
    assert [(r["category"], r["count"]) for r in got] == [("spicy", 1), ("light", 1), ("sweet", 10)]


@pytest.mark.parametrize(("p", "n", "percent", "band"), [(12, 2, 86, "positive"), (1, 1, 50, "mixed"), (0, 3, 0, "negative"), (0, 0, 50, "mixed"), (1, 7, 13, "negative")])
def test_bands(spark, p, n, percent, band):
    x = spark.createDataFrame([(p, n)], "p long, n long").withColumn("c", scores.percent_positive(F.col("p"), F.col("n"))).withColumn("b", scores.band(F.col("c"))).first()
    assert (x["c"], x["b"]) == (percent, band)
