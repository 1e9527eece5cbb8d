"""Connected components of links, inside a task with arrays and between tasks with joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import stored


class Forest:
    """Union-find over positions 0..n-1, joined in bulk; the root of a set is its smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                break
            r = up
        self.parent[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        while (open_ := a != b).any():
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            a, b = self.roots(a), self.roots(b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions that are not a root, and their roots: a spanning star of each set."""
        n = np.arange(len(self.parent))
        r = self.roots(n.copy())
        other = np.flatnonzero(r != n)
        return other, r[other]


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b); the root is the smallest node of its component.

    Alternates two steps until nothing changes, in a number of rounds that grows with the logarithm of the longest
    path: every node hands its smallest neighbour to its larger neighbours, then to its smaller ones. The smallest
    neighbour is a partial aggregate and is joined back, so a node with very many links is split by the adaptive skew
    join instead of being gathered. Each round is stored. Nulls and self-links are ignored; no edges give no rows.
    """
    e = stored(edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        around = _both_ways(e)
        least = around.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m"))
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = stored(small.select("e.*").filter("a != b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # Every remaining edge leads from a node straight to its root.
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
