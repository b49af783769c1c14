"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


#: So many links are joined in one task; more are contracted first.
FEW_EDGES = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node but the smallest of its component, with that smallest, by union and find."""
    parts = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")], 1) for batch in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts), return_inverse=True)
    parent = list(range(len(nodes)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, j in at.reshape(-1, 2).tolist():
        i, j = top(i), top(j)
        parent[max(i, j)] = min(i, j)
    tops = np.array([top(k) for k in range(len(nodes))])
    below = np.flatnonzero(tops != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[tops[below]])], ["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link.

    edges: columns a and b, any order, repeats and loops allowed; a row with a
    null end is no link. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the longest path. As soon as
    there are at most FEW_EDGES links, one task joins them. Nodes are longs.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        if edges.count() <= FEW_EDGES:
            edges = written(edges.coalesce(1).mapInArrow(_joined, "a long, b long"), "edges")
            break
        edges = written(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    top = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(top)
