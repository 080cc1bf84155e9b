import random
from collections import defaultdict

from crumbtrail.operators.heavy_keys import heavy_keys, key_figures

SCHEMA = "id long, k long, v int, t string, key string, n_records long"


def figures(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return key_figures(df, "id", "k", "v", "t")


def test_against_plain_python(spark):
    r = random.Random(1)
    rows = [(i, r.choice([1, 1, 1, 1, 2, 3, None, r.randint(4, 900)]), r.choice([None, 1, 2, 5]), r.choice([None, "", "ab", "x" * r.randint(0, 3000)]), "clash", 7) for i in range(4000)]
    rows += rows[:100]
    want = defaultdict(lambda: [0, 0, 0, 0])
    for _, k, v, t, *_ in rows[:4000]:
        w = want[k]
        w[0] += 1
        w[1] += v is not None
        w[2] += v or 0
        w[3] = max(w[3], len(t or ""))
    got = {x["k"]: [x["n_records"], x["n_values"], x["sum_values"], x["longest"]] for x in figures(spark, rows).collect()}
    assert got == dict(want)


def test_means_and_nulls(spark):
    rows = [(1, 5, None, None, None, None), (2, None, 3, "abc", None, None), (None, 5, 9, "left out", None, None)]
    got = {x["k"]: (x["n_records"], x["mean_value"], x["longest"]) for x in figures(spark, rows).collect()}
    assert got == {5: (1, None, 0), None: (1, 3.0, 3)}


def test_empty(spark):
    assert figures(spark, []).collect() == []


def test_heavy(spark):
    rows = [(i, 1 if i < 97 else None if i < 99 else 2, 1, "t", None, None) for i in range(100)]
    assert {x["k"] for x in heavy_keys(figures(spark, rows), "k", 0.01).collect()} == {1, 2}
    assert {x["k"] for x in heavy_keys(figures(spark, rows), "k", 0.02).collect()} == {1}


def test_string_keys_and_very_long_text(spark):
    df = spark.createDataFrame([(1, "a", 1, "x" * 2_000_000), (2, "a", 2, "y"), (3, "", 2, "")], "id long, k string, v int, t string")
    got = {x["k"]: (x["n_records"], x["longest"]) for x in key_figures(df, "id", "k", "v", "t").collect()}
    assert got == {"a": (2, 2_000_000), "": (1, 0)}
