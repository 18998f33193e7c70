"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.parent.setdefault(min(a, b), min(a, b))


def _contract(edges: DataFrame) -> DataFrame:
    """Each task's edges replaced by a star for each component among them; tasks hold a bounded part of the edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def stars() -> pa.RecordBatch:
            nodes = [x for x in forest.parent if forest.root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            if len(forest.parent) > 500_000:
                yield stars()
                forest = Forest()
        yield stars()

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _smallest_neighbour(pairs: DataFrame, scratch: list[str]) -> DataFrame:
    """Written apart: joined as it stands, it would share its exchange with the pairs, whose hubs Spark then couldn't split."""
    return common.durable(pairs.groupBy("a").agg(F.min("b").alias("least")), "least", scratch)


def _large_star(edges: DataFrame, scratch: list[str]) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest_neighbour(both, scratch).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame, scratch: list[str]) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _smallest_neighbour(down, scratch)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).where("a <> b")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is a centre or has one edge to a centre; edges lead to the smaller node."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``a``, ``b``: every node of the edges and the smallest node of its component (also the smallest itself).

    Each round is written to the shared folder, and its tables go when the next one is. Rows without a node give nothing, repeated rows count once, empty tables give
    no rows. Hubs are no hot groups: what gathers by node is a pre-aggregated minimum, and the
    joins are plain ones that Spark splits where keys are skewed.
    """
    old: list[str] = []
    edges = common.durable(_contract(edges.where("a <> b")), "edges", old)
    while not _are_stars(edges):
        if not (rounds := rounds - 1):
            raise RuntimeError("components aren't found after so many rounds")
        new: list[str] = []
        stars = common.durable(_small_star(_large_star(edges, old), old).distinct(), "edges", new)
        common.remove(edges.sparkSession, old)
        edges, old = stars, new
    return edges.union(edges.select("b", "b").distinct())


def labels_in(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links the smallest index of each row's component."""
    n = len(linked)
    labels = np.arange(n)
    while True:
        near = np.where(linked, labels[None, :], n).min(axis=1, initial=n)
        new = np.minimum(labels, near)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new
