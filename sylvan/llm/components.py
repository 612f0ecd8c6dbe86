"""Connected components of an edge table by alternating stars.

Every step turns edges into edges of the same components, until each node hangs on its component's least node. A task
first shrinks its own edges to a forest. Hot nodes are aggregated before the shuffle and joined by a table that has each
node once, which skew joins may split. No edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.util import steady, stored


def find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return int(x)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) for nodes that are not themselves least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:  # hook roots on smaller roots, then shorten paths
        px, py = parent[x], parent[y]
        if (px == py).all():
            break
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def shrink(edges: DataFrame, most: int = 1 << 18) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(np.asarray(whole["a"]), np.asarray(whole["b"]))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield out()
        if held:
            yield out()

    return edges.mapInArrow(steady(run), "a long, b long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges(a, b) of long ids -> (node, root) for each node but the roots."""
    now = stored(spark, shrink(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")), "edges")
    before = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
        if mark in (before, (0, None)):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Written between the two stars: one plan for both reads this one three times, and the driver holds a plan anew at each of its stages.
        large = stored(spark, both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"), "stars")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(small.select("a", F.col("m").alias("b")))
        now = stored(spark, linked.distinct(), "edges")
