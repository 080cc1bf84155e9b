"""Connected components of pairwise matches over a two-dimensional grid of edge blocks.

Vertices are numbered by a hash of their names and hashed into blocks; an edge lies in the grid cell (block of its one end,
block of its other). Each cell joins its own edges with a local union-find and names, for each of its
vertices, a representative of its local group. A vertex then takes one of the representatives that its
row and column of cells give it as its parent, and whatever else they gave it becomes an edge to that parent in the
next, smaller round, on a grid that shrinks with the edges; the edges of one cell's size are joined in one. When no such edge is left, the
parents are followed back to the first round, and each group is named by its smallest vertex.

Representatives are chosen by an order that changes with the round, or a chain in that order would lose one edge a round. A
vertex with very many edges spreads over all cells of its row, so no task holds all of them, and nothing but counts of edges
comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crumbtrail.functions.text import normalize
from crumbtrail.llm.words import mix
from crumbtrail.operators.similarity import local_groups
from crumbtrail.session import stage

#: Edges that one cell holds on average; a cell is joined in one task.
CELL_EDGES = 200_000
#: Blocks of the first grid, at least.
LEAST_BLOCKS = 3


def _join_cells(round_: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Union-find over the cells of one partition: a vertex of a cell and its representative there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        scopes = table["scope"].combine_chunks().dictionary_encode()
        cell, scope = (np.tile(x, 2) for x in (table["cell"].to_numpy(), scopes.indices.to_numpy()))
        ends = np.r_[table["a"].to_numpy(), table["b"].to_numpy()]
        # Numbers in the order of the round, cell by cell and scope by scope, so that the smallest number is the representative.
        order = np.lexsort((ends, mix(ends.view(np.uint64) ^ mix(np.full(1, round_ + 1, np.uint64))), scope, cell))
        c, s, v = cell[order], scope[order], ends[order]
        new = np.r_[True, (np.diff(c) != 0) | (np.diff(s) != 0) | (np.diff(v) != 0)]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        root = local_groups(number[: len(table)], number[len(table) :], int(new.sum()))
        s, v = s[new], v[new]
        yield pa.RecordBatch.from_arrays([scopes.dictionary.take(pa.array(s)), pa.array(v), pa.array(v[root])], names=["scope", "v", "rep"])

    return run


def _cells(edges: DataFrame, blocks: int) -> DataFrame:
    def block(c: str):
        return F.pmod(F.xxhash64("scope", c), F.lit(blocks))

    return edges.withColumn("cell", (block("a") * blocks + block("b")).cast("int"))


def components(pairs: DataFrame, scope: str, a: str, b: str, cell_edges: int = CELL_EDGES) -> DataFrame:
    """scope, name, group_name: each vertex that a pair ties to another, with its group's smallest.

    A vertex is a (scope, name) and pairs tie names of one scope. Pairs with a null and pairs of
    a name with itself tie nothing. Repeated and turned pairs count once. Names are ordered by
    their UTF-8 bytes (by Unicode code point, which is the same order). No pairs, no rows. Columns
    besides the three are not read. Within a scope names are told apart by 64 bits.
    """
    kind = pairs.schema[scope].dataType.simpleString()
    given = pairs.where(F.col(scope).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    named = stage(given.select(F.col(scope).alias("scope"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "pairs")
    vertices = named.select("scope", F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("v", F.xxhash64("name"))
    edges = named.select("scope", F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    rounds: list[DataFrame] = []
    n = edges.count()
    while n:
        blocks = int((n / cell_edges) ** 0.5) + 1 if rounds else max(LEAST_BLOCKS, int((n / cell_edges) ** 0.5) + 1)
        local = _cells(edges, blocks).repartition(blocks * blocks, "cell").mapInArrow(_join_cells(len(rounds)), f"scope {kind}, v long, rep long")
        # A vertex has at most one representative from each cell of its row and its column.
        parent = F.array_min(F.transform("reps", lambda r: F.struct(F.xxhash64(F.lit(len(rounds)), r).alias("h"), r.alias("rep"))))["rep"]
        named = stage(local.groupBy("scope", "v").agg(F.collect_set("rep").alias("reps")).withColumn("parent", parent), "representatives")
        rounds.append(named.select("scope", "v", "parent"))
        edges = named.where(F.size("reps") > 1).select("scope", F.col("parent").alias("a"), F.explode("reps").alias("b")).where("a != b").distinct()
        edges = stage(edges, "edges")
        n = edges.count()
    if not rounds:
        return vertices.select(F.col("scope").alias(scope), "name", F.col("name").alias("group_name"))
    # Each round's parents are vertices of the next, unless they are already the last.
    found = rounds.pop()
    while rounds:
        up = found.select("scope", F.col("v").alias("parent"), F.col("parent").alias("top"))
        found = rounds.pop().join(up, ["scope", "parent"], "left").select("scope", "v", F.coalesce("top", "parent").alias("parent"))
    members = stage(vertices.join(found, ["scope", "v"]), "members")
    names = members.groupBy("scope", "parent").agg(F.min("name").alias("group_name"))
    return members.join(names, ["scope", "parent"]).select(F.col("scope").alias(scope), "name", "group_name")


def matched_names(matches: DataFrame, bound: float = 0.87) -> DataFrame:
    """``components`` of a table of scored name pairs (business_id, name_a, name_b, similarity).

    A pair counts if both names are given and not blank and its similarity is a number of at
    least ``bound``; null and NaN are none.
    """
    sure = matches.where(F.col("similarity").isNotNull() & ~F.isnan("similarity") & (F.col("similarity") >= bound))
    named = sure.select("business_id", normalize(F.col("name_a")).alias("name_a"), normalize(F.col("name_b")).alias("name_b"))
    return components(named.where((F.col("name_a") != "") & (F.col("name_b") != "")), "business_id", "name_a", "name_b")
