import time

import pytest
from pyspark.sql import functions as F

from crumbtrail import providers
from crumbtrail.streaming.ledger import read_ledger, read_mentions, start_extraction

REVIEW = "id long, business_id long, review_text string"


def test_failures_stay_apart(spark):
    def flaky(text):
        if "bad" in text:
            raise RuntimeError("no")
        return [{"dish": text, "sentiment": "neutral", "tags": []}]

    df = spark.createDataFrame([(1, 1, "ok"), (2, 1, "bad one"), (3, 2, "fine")], REVIEW)
    found = providers.extract(df, flaky, concurrency=2, wait=(0.0, 0.0))
    assert tuple(providers.run_counts(found).first()) == (2, 2, 1)
    assert {r["review_id"] for r in providers.mention_rows(found).collect()} == {1, 3}
    with pytest.raises(ValueError):
        providers.extract(df, flaky, concurrency=51)


def test_lexicon_extractor():
    assert providers.lexicon_extractor("The lamb curry was tender and rich. Our soup was cold!") == [{"dish": "lamb curry", "sentiment": "positive", "tags": ["tender", "rich"]}, {"dish": "soup", "sentiment": "negative", "tags": ["cold"]}]
    assert providers.lexicon_extractor("") == [] == providers.lexicon_extractor(None)


def test_embedding_once_per_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, key string")
    got = {r["id"]: r["embedding"] for r in providers.embed(df, "key", providers.hashing_embedder(8)).collect()}
    assert got[1] == got[2] and len(got[1]) == 8 and got[3] is None


def test_empty_and_outdated_blurbs_are_misses(spark, tmp_path):
    ranked = spark.createDataFrame([(1, "x", 3, 2, 1, ["hot"]), (1, "y", 3, 2, 1, [])], "business_id long, name string, mention_count long, positive_count long, negative_count long, tags array<string>")
    cache = providers.blurb_cache(ranked.withColumn("blurb", F.when(F.col("name") == "y", "held").otherwise("")))
    out, new = providers.with_blurbs(ranked, cache)
    assert {r["name"]: r["blurb"] for r in out.collect()} == {"x": "x: praised by 2 of 3 voters; hot.", "y": "held"}
    assert [r["name"] for r in new.collect()] == ["x"]
    path = str(tmp_path / "blurbs")
    providers.keep_blurbs(cache, path)
    providers.keep_blurbs(new, path)
    stored = spark.read.parquet(path)
    assert providers.with_blurbs(ranked, stored)[1].count() == 0
    # Other counts or tags: the stored text no longer holds.
    changed = ranked.withColumn("positive_count", F.col("positive_count") + 1)
    assert {r["blurb"] for r in providers.with_blurbs(changed, stored)[0].collect()} == {"x: praised by 3 of 4 voters; hot.", "y: praised by 3 of 4 voters; no tags yet."}


def test_stream_extracts_each_review_once(spark, tmp_path):
    source, out = str(tmp_path / "reviews"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "The soup was rich."), (2, 1, "Nothing.")], REVIEW).write.parquet(source)
    start_extraction(spark, source, out).awaitTermination()
    spark.createDataFrame([(2, 1, "Nothing."), (3, 1, "The pie was cold.")], REVIEW).write.mode("append").parquet(source)
    start_extraction(spark, source, out).awaitTermination()
    assert sorted(r["dish_name"] for r in read_mentions(spark, out).collect()) == ["pie", "soup"]
    assert sorted(r["review_id"] for r in read_ledger(spark, out).collect()) == [1, 2, 3]


def test_failures_are_tried_again_with_the_next_run(spark, tmp_path):
    source, out = str(tmp_path / "reviews"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "The soup was rich."), (2, 1, "The pie was cold.")], REVIEW).write.parquet(source)

    def broken(text):
        if "pie" in text:
            raise RuntimeError("no")
        return providers.lexicon_extractor(text)

    start_extraction(spark, source, out, broken, attempts=2, wait=(0.0, 0.0)).awaitTermination()
    assert [r["review_id"] for r in read_ledger(spark, out).collect()] == [1]
    start_extraction(spark, source, out).awaitTermination()
    assert sorted(r["review_id"] for r in read_ledger(spark, out).collect()) == [1, 2]
    assert sorted(r["dish_name"] for r in read_mentions(spark, out).collect()) == ["pie", "soup"]
    start_extraction(spark, source, out).awaitTermination()
    assert read_mentions(spark, out).count() == 2


def test_waits_grow_between_attempts(monkeypatch, spark):
    df = spark.createDataFrame([(1, 1, "x")], REVIEW)

    def never(text):
        raise RuntimeError("no")

    began = time.time()
    assert providers.extract(df, never, attempts=3, wait=(0.2, 0.3)).first()["error"] == "RuntimeError: no"
    assert time.time() - began >= 0.5


def test_pattern_finds_what_the_extractor_finds(spark):
    texts = ["The lamb curry was tender and rich. Our soup was cold!", "", None, "My pie tasted fine\nthe tea is bad", "Nothing here."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    for r in df.select("t", providers.pattern_mentions(F.col("t")).alias("m")).collect():
        assert [(m["dish"], m["sentiment"], m["tags"]) for m in r["m"]] == [(m["dish"].lower(), m["sentiment"], m["tags"]) for m in providers.lexicon_extractor(r["t"])]
