import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from crumbtrail.functions.text import address_line, highlight, normalize, split_csv, strip
from crumbtrail.operators import ingest, pending, trim
from crumbtrail.operators.search import exists, find_businesses, first_matches, listing, name_of, pick, review_text, suggestions
from crumbtrail.sources import ndjson, sinks


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [(" Crème \t Brûlée\x1c ", "crème brûlée"), ("\n A  b", "a b"), ("", ""), (None, None)])
def test_normalize(spark, text, want):
    assert one(spark, text, normalize) == want


def test_strip_keeps_inner_space(spark):
    assert one(spark, "\t a  b ", strip) == "a  b"


def test_split_csv(spark):
    assert one(spark, "Mexican, Restaurants,, ", split_csv) == ["Mexican", "Restaurants"]
    assert one(spark, None, split_csv) == []


@pytest.mark.parametrize(("parts", "want"), [((None, "C", "", "1"), "N — C, 1"), ((None, "", None, ""), "N")])
def test_address(spark, parts, want):
    df = spark.createDataFrame([("N", *parts)], "n string, a string, b string, c string, d string")
    assert df.select(address_line(*[F.col(c) for c in "nabcd"]).alias("x")).first()["x"] == want


def test_highlight(spark):
    assert tuple(one(spark, "Banana", lambda c: highlight(c, "AN"))) == ("B", "an", "ana")
    assert tuple(one(spark, "Banana", lambda c: highlight(c, "x"))) == ("Banana", "", "")


def test_cities():
    assert trim.parse_cities("Philadelphia:PA, New Orleans:LA") == [("Philadelphia", "PA"), ("New Orleans", "LA")]
    for bad in ("Philadelphia", "Philadelphia:", ":PA", "Philadelphia:PA,", " : PA"):
        with pytest.raises(ValueError):
            trim.parse_cities(bad)


BUSINESS = "id long, yelp_business_id string, name string, address string, city string, state string, postal_code string, categories array<string>, yelp_stars decimal(2,1), yelp_review_count int"


def test_upsert_keeps_the_first_city_and_takes_nulls(spark):
    old = spark.createDataFrame([(1, "b1", "A", "1 St", "X", "S", "9", ["c"], Decimal("4.0"), 5)], BUSINESS)
    new = spark.createDataFrame([(2, "b1", "B", None, "Y", "T", None, [], None, 6), (3, "b2", "C", None, "Z", None, None, None, None, None)], BUSINESS)
    got = {r["yelp_business_id"]: r for r in ingest.upsert(old, new, "yelp_business_id", "id", ingest.UPDATED, ingest.KEPT).collect()}
    assert (got["b1"]["name"], got["b1"]["address"], got["b1"]["city"], got["b1"]["yelp_stars"], got["b1"]["categories"]) == ("B", None, "X", None, ["c"])
    assert got["b2"]["city"] == "Z"


REVIEW = "id long, business_id long, yelp_review_id string, review_text string, extracted_at timestamp"


def reviews(spark, rows):
    stamp = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 1, f"r{i}", "x" * n, stamp if done else None) for i, n, done in rows], REVIEW)


GIVEN = [(1, 10, True), (2, 50, False), (3, 40, False), (4, 5, True), (5, 60, False)]


@pytest.mark.parametrize(("k", "want"), [(1, {1, 4}), (2, {1, 4}), (3, {1, 4, 5}), (9, {1, 2, 3, 4, 5})])
def test_cap_protects_extracted(spark, k, want):
    assert {r["id"] for r in trim.cap_reviews(reviews(spark, GIVEN), k).collect()} == want


def test_work_list(spark):
    df = reviews(spark, GIVEN)
    assert [r["id"] for r in pending.work_list(df, max_per_business=2).collect()] == [2, 5]
    assert [r["id"] for r in pending.work_list(df, limit=2).collect()] == [2, 3]
    assert pending.work_list(df, business_id=7).count() == 0


def test_insert_ignore(spark):
    old = spark.createDataFrame([("a", 1)], "k string, seq long")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "k string, seq long")
    got = ingest.insert_ignore(old, new, "k", "seq")
    assert [tuple(r) for r in got.collect()] == [("b", 3)]
    assert tuple(ingest.load_counts(new, got).first()) == (3, 1)


def _lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_filter_passes_lines_through(spark, tmp_path):
    kept = '{"business_id": "1",   "name":"A", "city":" Springfield ", "state":"IL", "categories":"Mexican, Restaurants"}'
    businesses = _lines(tmp_path / "b.json", [kept, {"business_id": "2", "name": "B", "city": "Elsewhere", "state": "IL", "categories": None}])
    texts = _lines(tmp_path / "r.json", [{"review_id": "x", "business_id": "1", "text": "t"}, {"review_id": "y", "business_id": "2", "text": "t"}])
    ndjson.filter_dataset(spark, businesses, texts, str(tmp_path / "out"), city="springfield", state="il")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/business")).collect()] == [kept]
    assert spark.read.text(str(tmp_path / "out/review")).count() == 1
    with pytest.raises(ValueError):
        ndjson.filter_dataset(spark, businesses, texts, str(tmp_path / "none"), city="nowhere")


def test_malformed_and_incomplete_rows_fail(spark, tmp_path):
    for name, row in (("bad", "{not json"), ("short", {"business_id": "1"})):
        with pytest.raises(Exception):  # noqa: B017
            ndjson.read_businesses(spark, _lines(tmp_path / f"{name}.json", [row])).collect()


def test_a_missing_key_fails_whatever_is_read(spark, tmp_path):
    path = _lines(tmp_path / "s.json", [{"business_id": "1", "name": "A", "city": "X"}, {"business_id": "2", "city": "Y"}])
    with pytest.raises(Exception):  # noqa: B017
        ndjson.read_businesses(spark, path).select("city").collect()


def test_incoming_reviews(spark, tmp_path):
    path = _lines(tmp_path / "v.json", [{"review_id": "r", "business_id": "1", "text": "t", "stars": 4.0, "date": "2019-05-02 18:20:00"}, {"review_id": "s", "business_id": "1", "text": "t"}])
    rows = {r["yelp_review_id"]: r for r in ingest.incoming_reviews(ndjson.read_reviews(spark, path)).collect()}
    assert rows["r"]["review_date"] == datetime.date(2019, 5, 2) and rows["r"]["stars"] == 4 and rows["s"]["review_date"] is None
    bad = _lines(tmp_path / "w.json", [{"review_id": "r", "business_id": "1", "text": "t", "date": "soon"}])
    with pytest.raises(Exception):  # noqa: B017
        ingest.incoming_reviews(ndjson.read_reviews(spark, bad)).collect()


def test_null_categories_are_none(spark, tmp_path):
    raw = ndjson.read_businesses(spark, _lines(tmp_path / "n.json", [{"business_id": "1", "name": "A", "categories": None, "stars": 4.5}]))
    row = ingest.incoming_businesses(raw).first()
    assert row["categories"] == [] and row["yelp_stars"] == Decimal("4.5")


def test_swap_may_read_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    sinks.swap(spark.read.parquet(path).where("id > 6"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [7, 8, 9]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_failed_swap_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    rename = sinks._rename

    def failing(files, source, target):
        if ".new-" in source.toString():
            raise OSError("no")
        rename(files, source, target)

    monkeypatch.setattr(sinks, "_rename", failing)
    with pytest.raises(OSError):
        sinks.swap(spark.read.parquet(path).where("id > 6"), path)
    assert spark.read.parquet(path).count() == 10


def test_a_rename_that_hadoop_refuses_is_an_error():
    class Files:
        def rename(self, source, target):
            return False

    with pytest.raises(OSError):
        sinks._rename(Files(), "a", "b")


def test_copy(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a"))
    sinks.copy_table(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 5


def test_scratch_folder_must_be_shared_on_a_cluster(tmp_path):
    from types import SimpleNamespace

    from crumbtrail.session import shared_dir

    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)

    with pytest.raises(RuntimeError):
        shared_dir(session("spark://head:7077"))
    assert shared_dir(session("local[4]")).startswith("file:")


def test_overwrite_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "business_id long, name string"), path)
    sinks.overwrite_partitions(spark.createDataFrame([(2, "c")], "business_id long, name string"), path)
    assert sorted((r["business_id"], r["name"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_search(spark):
    df = spark.createDataFrame([(i, f"Place {i:02d}") for i in range(30)], "id long, name string")
    assert find_businesses(df, "PLACE 0_").count() == 10
    assert {r["overflow"] for r in first_matches(find_businesses(df, "place")).collect()} == {10}
    assert pick(df, 3).first()["id"] == 2 and name_of(df, 4) == "Place 04"
    for call in (lambda: find_businesses(df, " "), lambda: pick(df, 21), lambda: pick(df, 0)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(LookupError):
        name_of(df, 99)
    assert exists(df, 4) and not exists(df, 99)


def test_suggestions_need_two_letters(spark):
    df = spark.createDataFrame([(1, "Annex", None, None, None, None)], "id long, name string, address string, city string, state string, postal_code string")
    assert suggestions(df, " a ").count() == 0 and suggestions(df, " an ").count() == 1 and suggestions(df, "a", 1).count() == 1


def test_review_text(spark):
    df = spark.createDataFrame([(1, "good"), (2, None)], "id long, review_text string")
    assert review_text(df, 1) == "good" and review_text(df, 2) is None
    with pytest.raises(LookupError):
        review_text(df, 3)


def test_listing_order(spark):
    df = spark.createDataFrame([(1, 7, 2), (2, 7, 5), (3, 7, 5), (4, 8, None)], "id long, business_id long, mention_count long")
    assert {(r["id"], r["position"]) for r in listing(df).collect()} == {(2, 1), (3, 2), (1, 3), (4, 1)}
