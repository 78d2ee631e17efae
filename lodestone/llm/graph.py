"""Connected components of undirected graphs, by alternating large and small stars (Kiveris et al., 2014); a graph of few edges is united in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, mapped, written

#: Edges up to which one task unites them, at some 100 bytes each.
FEW = 200_000


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of n nodes."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _united(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges at once."""
    parts = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in it]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = forest(at[: len(a)], at[len(a) :], len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], ["id", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b, after one step: of each node, its larger (or smaller) neighbours go to its smallest one, itself included. The smallest ones are a table of their own,
    so that Spark can split the join of a hot node."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    moved = both.join(least, "a").filter("b > a and b > m" if large else "b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written((moved if large else moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a > b")).distinct(), "edges")
    dropped(least)
    return out


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(id, component) of each node with an edge; component is the smallest id that can be reached. edges: (a, b), in any order, a != b.

    More than `few` edges take steps, each written to the shared folder; the loop ends when a step changes nothing, seen by the count and a sum of hashes of its edges.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = None
    if now.count() <= few:
        return mapped(now.coalesce(1), _united, "id long, component long")
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        half = _star(now, True)
        then = _star(half, False)
        dropped(now, half)
        now = then
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
