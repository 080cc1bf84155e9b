"""Similar pairs of vectors within a scope, and their connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crumbtrail.session import stage

#: Scopes up to which a table of them is sent to every executor (some 20 bytes each).
BROADCAST_ROWS = 500_000
#: Edges that a task turns into stars at a time.
FOREST_EDGES = 500_000


def _cell_pairs(threshold: float, scope_type: pa.DataType, key_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Matrix products of the cells of a partition; its rows come sorted by cell, and one cell is held at a time."""

    def pairs(scope: object, cell: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, low, high, *_ = cell[0]
        by_length: dict[int, list[tuple]] = {}
        for row in cell:
            by_length.setdefault(len(row[5]), []).append(row)
        for rows in by_length.values():
            m = np.array([r[5] for r in rows], dtype=np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
            own = np.array([r[3] for r in rows])
            left = np.flatnonzero(own == low)
            right = left if low == high else np.flatnonzero(own == high)
            with np.errstate(invalid="ignore"):
                similar = m[left] @ m[right].T
                i, j = np.nonzero(similar >= threshold)
            if low == high:
                i, j = i[i < j], j[i < j]
            ends = [sorted((rows[x][4], rows[y][4])) for x, y in zip(left[i], right[j])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([scope] * len(ends), scope_type), pa.array([e[0] for e in ends], key_type), pa.array([e[1] for e in ends], key_type), pa.array(similar[i, j])], names=["s", "a", "b", "similarity"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if cell and row[:3] != cell[0][:3]:
                    yield from pairs(cell[0][0], cell)
                    cell = []
                cell.append(row)
        if cell:
            yield from pairs(cell[0][0], cell)

    return run


def similar_pairs(df: DataFrame, scope: str, key: str, vector: str, threshold: float, block: int = 2000) -> DataFrame:
    """scope, a, b (a < b), similarity: all pairs of a scope with a cosine of at least ``threshold``.

    Exact, in doubles. Zero and null vectors are similar to none, nor are vectors of different lengths. A large scope
    is cut into blocks of about ``block`` vectors; each pair of blocks is a cell, one matrix product, so that a scope's
    pairs spread over many tasks. A vector is sent to as many cells as its scope has blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [df.schema[c].dataType for c in (scope, key)]
    given = df.where(F.col(vector).isNotNull() & F.col(scope).isNotNull() & (F.size(vector) > 0)).select(F.col(scope).alias("s"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    # Only scopes of several blocks are looked up; where they are few they are sent to all tasks, so that no scope's vectors are shuffled for it.
    large = stage(given.groupBy("s").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"), "large-scopes")
    few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    cut = given.join(F.broadcast(large) if few else large, "s", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    cells = cut.select("s", "own", "k", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("s", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "k", "v")
    sorted_cells = cells.repartition("s", "low", "high").sortWithinPartitions("s", "low", "high")
    met = sorted_cells.mapInArrow(_cell_pairs(threshold, *[to_arrow_type(k) for k in kinds]), f"s {kinds[0].simpleString()}, a {kinds[1].simpleString()}, b {kinds[1].simpleString()}, similarity double")
    return met.select(F.col("s").alias(scope), "a", "b", "similarity")


def local_groups(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that edges tie each of the numbers 0 to n - 1 to."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: each vertex and the smallest that these edges tie it to, some batches at a time."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = pa.table({"s": pa.concat_arrays([table["s"].combine_chunks()] * 2), "k": pa.concat_arrays([table["a"].combine_chunks(), table["b"].combine_chunks()])})
        vertices = ends.group_by(["s", "k"]).aggregate([]).sort_by([("s", "ascending"), ("k", "ascending")])
        numbered = vertices.append_column("n", pa.array(np.arange(len(vertices))))
        at = ends.append_column("_at", pa.array(np.arange(len(ends)))).join(numbered, ["s", "k"]).sort_by("_at")["n"].to_numpy()
        root = local_groups(at[: len(table)], at[len(table) :], len(vertices))
        out = np.flatnonzero(root != np.arange(len(root)))
        a, b = vertices.take(pa.array(root[out])), vertices.take(pa.array(out))
        return pa.RecordBatch.from_arrays([a["s"].combine_chunks(), a["k"].combine_chunks(), b["k"].combine_chunks()], names=["s", "a", "b"])

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FOREST_EDGES:
            yield stars()
            held, rows = [], 0
    if rows:
        yield stars()


def components(vertices: DataFrame, edges: DataFrame, scope: str, key: str) -> DataFrame:
    """scope, key, component: the smallest key that edges (scope, a, b) tie a vertex to, itself if none.

    Each task first turns its own edges into stars, so that what is left of a vertex with very many edges is one
    edge for each task. Then, round by round, each vertex takes the smallest of its neighbours as its parent, parents take theirs,
    and edges are drawn between the parents; those inside a group fall away, until none is left. Rounds are written to the
    shared folder. Smallest is by the key's order, in strings by bytes.
    """
    kinds = [vertices.schema[c].dataType.simpleString() for c in (scope, key)]
    given = edges.select(F.col(scope).alias("s"), F.col("a").alias("a"), F.col("b").alias("b")).where("s IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a != b")
    left = stage(given.mapInArrow(_forest, f"s {kinds[0]}, a {kinds[1]}, b {kinds[1]}"), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select("s", F.col("a").alias("k"), F.col("b").alias("o")).union(left.select("s", F.col("b"), F.col("a")))
        near = ends.groupBy("s", "k").agg(F.least(F.min("o"), F.first("k")).alias("p"))
        far = near.select("s", F.col("k").alias("p"), F.col("p").alias("q"))
        parents = stage(near.join(far, ["s", "p"]).select("s", "k", F.col("q").alias("p")), "parents")
        up = parents.select("s", F.col("k").alias("a"), F.col("p").alias("pa"))
        across = parents.select("s", F.col("k").alias("b"), F.col("p").alias("pb"))
        moved = left.join(up, ["s", "a"]).join(across, ["s", "b"]).where("pa != pb").select("s", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = stage(moved, "edges")
        rounds.append(parents)
    if not rounds:
        return vertices.select(scope, key).distinct().withColumn("component", F.col(key))
    found = rounds.pop()
    while rounds:
        up = found.select("s", F.col("k").alias("p"), F.col("p").alias("top"))
        found = rounds.pop().join(up, ["s", "p"], "left").select("s", "k", F.coalesce("top", "p").alias("p"))
    # A parent need not be its group's smallest: the smallest of all members names the group.
    least = found.groupBy("s", "p").agg(F.least(F.min("k"), F.first("p")).alias("c"))
    named = found.join(least, ["s", "p"]).select(F.col("s").alias(scope), F.col("k").alias(key), "c")
    return vertices.select(scope, key).distinct().join(named, [scope, key], "left").select(scope, key, F.coalesce("c", key).alias("component"))
