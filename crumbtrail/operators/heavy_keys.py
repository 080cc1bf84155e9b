"""Figures per key that stay balanced when a few keys hold most rows.

Dense accumulator arrays: each split dictionary-encodes its keys and scatter-reduces its rows
into arrays (``numpy.bincount`` and ``ufunc.at``), so a split sends one entry per key, however
many rows a key has. The entries go to blocks of keys by hash; there the arrays of all splits
are summed the same way. A task's work is bounded by its split, not by the largest key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ("n_records", "n_values", "sum_values")
TOPS = ("longest",)


def _grow(a: np.ndarray, n: int, empty: float) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.full(max(n, 2 * len(a)) - len(a), empty)])


def _scatter(first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums a partition's rows (``first``: records, else entries of splits) into dense arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        sums, tops, kind = [np.zeros(0) for _ in SUMS], [np.zeros(0) for _ in TOPS], None
        for batch in batches:
            col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            kind = col["key"].type
            encoded = col["key"].dictionary_encode(null_encoding="encode")
            at = np.array([codes.setdefault(x, len(codes)) for x in encoded.dictionary.to_pylist()], dtype=np.int64)
            if not len(at):
                continue
            slot, n = at[encoded.indices.to_numpy(zero_copy_only=False)], len(codes)

            def nums(name: str) -> np.ndarray:
                return col[name].cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)

            if first:
                given = col["value"].is_valid().to_numpy(zero_copy_only=False)
                weights, lengths = [None, given.astype(float), nums("value")], [nums("length")]
            else:
                weights, lengths = [nums(c) for c in SUMS], [nums(c) for c in TOPS]
            for k, w in enumerate(weights):
                sums[k] = _grow(sums[k], n, 0)
                sums[k][:n] += np.bincount(slot, weights=w, minlength=n)
            for k, x in enumerate(lengths):
                tops[k] = _grow(tops[k], n, 0)
                np.maximum.at(tops[k], slot, x)
        n, step = len(codes), 100_000
        if n:
            keys = pa.array(list(codes), type=kind)
            for lo in range(0, n, step):
                hi = min(n, lo + step)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), *(pa.array(a[lo:hi].astype(np.int64) if name != "sum_values" else a[lo:hi]) for name, a in zip((*SUMS, *TOPS), (*sums, *tops)))],
                    names=["key", *SUMS, *TOPS],
                )

    return run


def key_figures(df: DataFrame, record_id: str, key: str, value: str, text: str) -> DataFrame:
    """One row per key: key, n_records, n_values, sum_values, mean_value, longest.

    Records with a null id are left out, and a repeated id counts once. A null key is a key of
    its own, a null value counts as a record but not in the mean (null if a key has no value),
    a null text has length 0. Sums of integers are exact up to 2**53. An empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    narrow = df.where(F.col(record_id).isNotNull()).select(
        F.col(record_id).alias("_id"), F.col(key).alias("key"), F.col(value).cast("double").alias("value"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("length")
    )
    # Hashed by id, the splits are equal whatever the keys are.
    records = narrow.dropDuplicates(["_id"]).select("key", "value", "length")
    schema = f"key {kind}, n_records long, n_values long, sum_values double, longest long"
    entries = records.mapInArrow(_scatter(True), schema)
    total = entries.repartition("key").mapInArrow(_scatter(False), schema)
    mean = F.try_divide(F.col("sum_values"), F.col("n_values").cast("double"))
    return total.select(F.col("key").alias(key), "n_records", "n_values", "sum_values", mean.alias("mean_value"), "longest")


def heavy_keys(figures: DataFrame, key: str, share: float) -> DataFrame:
    """The non-null keys with at least ``share`` of all records of ``key_figures``."""
    total = figures.agg(F.sum("n_records").alias("_total"))
    with_total = figures.crossJoin(F.broadcast(total))  # one row
    return with_total.where(F.col(key).isNotNull() & (F.col("n_records") >= F.lit(share) * F.col("_total"))).drop("_total")
