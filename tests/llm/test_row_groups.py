"""Spark decodes thousands of rows of a row group at once, so large rows need groups of their own."""

from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq

from crumbtrail.llm import leakage, spam_pages
from crumbtrail.session import stage


def groups(df):
    files = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in df.inputFiles()]
    return [f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]


def test_rows_of_a_group(spark):
    rows = stage(spark.range(25).coalesce(1), "rows", group_rows=10)
    assert groups(rows) == [10, 10, 5] and rows.count() == 25


def test_segments_are_decoded_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SEGMENT_LETTERS", 20)
    texts = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    index = leakage.build_index(texts, "doc_id", "text")
    assert groups(index) == [1] * 40
    assert sorted(i for row in index.collect() for i in row["ids"]) == list(range(40))


def test_batches_of_pages_are_decoded_one_at_a_time(spark, monkeypatch):
    staged = []

    def kept(df, *args, **kw):
        staged.append(stage(df, *args, **kw))
        return staged[-1]

    monkeypatch.setattr(spam_pages, "stage", kept)
    monkeypatch.setattr(spam_pages, "BATCH_LETTERS", 20)
    texts = spark.createDataFrame([(i, f"Some words of page {i}.") for i in range(40)], "doc_id long, text string")
    assert spam_pages.page_scores(texts, "doc_id", "text").count() == 40
    assert groups(staged[0]) == [1] * 40
    # What grows with the letters of a batch is packed; beside it are only its distinct keys.
    assert {c for c, kind in staged[0].dtypes if kind.startswith("array")} == {"keys", "n", "df"}
