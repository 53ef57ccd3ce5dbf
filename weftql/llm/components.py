"""Connected components by alternating large and small stars, two of each for a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftql.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each neighbour above a node to the least one around it. Small star: the node and its neighbours below."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


#: Edges that a task reduces to stars at a time, and to which all must have shrunk for one task to end the rounds.
FOREST_EDGES = 200_000


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 with edges (a, b) the least node that each reaches: roots hook onto lesser ones, paths halve."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges that connect the same nodes: a star for each component among a bounded number of edges of a partition."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        ends = [np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        root = least_reached(at[: len(ends[0])], at[len(ends[0]) :], len(nodes))
        own = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((nodes[own], nodes[root[own]]), held[0].schema, strict=True)], schema=held[0].schema)

    for whole in batches:
        for first in range(0, whole.num_rows, FOREST_EDGES):
            held.append(whole.slice(first, FOREST_EDGES))
            if sum(x.num_rows for x in held) >= FOREST_EDGES:
                yield stars()
                held = []
    if held:
        yield stars()


def connected_components(edges: DataFrame, label: str, max_rounds: int = 50) -> DataFrame:
    """node, root (the least node of its component) for every node of edges(a, b) with a <> b. No node or edge goes to the driver."""

    def marks(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).collect()[0])

    kind = edges.schema["a"].dataType.simpleString()
    shrunk = lambda df: df.mapInArrow(forest, f"a {kind}, b {kind}")
    now = materialize(shrunk(edges.select("a", "b").where("a <> b").distinct()).distinct(), label)
    mark = marks(now)
    for _ in range(max_rounds):
        if mark[0] <= FOREST_EDGES // 2:  # a bounded number: one task's work
            now, found = shrunk(now.coalesce(1)), mark
        else:
            now = materialize(_star(_star(_star(_star(now, True), False), True), False), label)
            found = marks(now)
        if found == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = found
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
