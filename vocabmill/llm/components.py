"""Connected components by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.  Each
round is two joins on the edges; minima are combined before they are shuffled.
Minima and edges are tables of the shared folder, so both sides of a join are
shuffled for it alone, and the rows of a hub can be split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._shared import Scratch

#: Edges of one file of a round's tables.
EDGES_A_FILE = 500_000


def _large_star(edges: DataFrame, scratch: Scratch, files: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")), "large", files)
    return both.join(least, F.col("u") == F.col("c")).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch, files: int) -> DataFrame:
    least = scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")), "small", files)
    rest = edges.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(rest).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node with an edge: root is the component's least node.

    edges: (u, v) longs, either way round, repeats and loops allowed.
    """
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    before, i = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, i = state, i + 1
        files = 1 + state[0] // EDGES_A_FILE
        stars = scratch.table(_large_star(now, scratch, files), "stars", files)
        now = scratch.table(_small_star(stars, scratch, files), f"edges{i}", files)
        for label in ("large", "small", "stars", f"edges{i - 1}"):
            scratch.drop(label)


class Labels:
    """Components among n local nodes, from links that come in parts."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            differ = a != b
            if not differ.any():
                return
            i, j, low = i[differ], j[differ], np.minimum(a, b)[differ]
            np.minimum.at(self.of, a[differ], low)
            np.minimum.at(self.of, b[differ], low)
            while (self.of[self.of] != self.of).any():
                self.of = self.of[self.of]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of each node that isn't its component's root."""
        nodes = np.flatnonzero(self.of != np.arange(len(self.of)))
        return nodes, self.of[nodes]
