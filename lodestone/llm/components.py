"""Connected components of a graph given by its edges, as a distributed job."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, materialise

_EDGES = "a long, b long"

#: Edges, of which each vertex has one at most, that one task joins up: some 50 MB.
ONE_TASK = 200_000


class Forest:
    """Union-find in which the smallest member is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        self.parent.setdefault(min(x, y), min(x, y))
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around the smallest member: at most one edge
    for each vertex."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            forest.union(a, b)
    out = [(v, root) for v in list(forest.parent) if (root := forest.find(v)) != v]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All vertices with the smallest member of their component."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            forest.union(a, b)
    out = [(v, forest.find(v)) for v in list(forest.parent)]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["id", "label"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Every vertex hands its larger (or its other) neighbours to the smallest of
    them and itself. edges (a, b) have a > b; so do those that come out."""
    if small:  # the smaller neighbours of a, and a itself, go to the smallest
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
    else:  # the larger neighbours of v go to the smallest neighbour of v, or v
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        least = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
        out = edges.withColumnRenamed("b", "v").join(least, "v").select("a", F.col("m").alias("b"))
    return out.distinct()


def _core(edges: DataFrame) -> DataFrame:
    """Components of a graph (a, b), a > b, as edges (a, smallest member)."""
    now, mark = materialise(edges, "stars"), None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (found["n"], found["h"]) == mark or found["n"] == 0:
            return now
        mark = (found["n"], found["h"])
        now = materialise(_star(_star(now, False), True), "stars")


def components(edges: DataFrame) -> DataFrame:
    """id, label for every vertex: label is the smallest id in its component.

    edges: a long, b long, in any order, repeated or not. Partitions first shrink
    their own edges to stars. If no more than ONE_TASK are left, one task joins
    them up. Otherwise every vertex hangs on its smallest neighbour,
    and only neighbours that others hang on go into the rounds (large-star and
    small-star until nothing changes; each vertex is joined with one number, no
    list of neighbours anywhere): a vertex with thousands of neighbours takes part
    as one. Each round is written, so a lost executor costs no earlier one.
    """
    larger = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    stars = materialise(map_arrow(larger.repartition("a"), _contract, _EDGES), "stars")
    if stars.count() <= ONE_TASK:
        return map_arrow(stars.coalesce(1), _labels, "id long, label long")
    up = materialise(stars.groupBy("a").agg(F.min("b").alias("p")), "stars")
    held = stars.select("b").distinct()
    across = stars.join(up, "a").where("b <> p").select(F.col("b").alias("x"), F.col("p").alias("y"))
    chained = up.join(held.withColumnRenamed("b", "a"), "a", "left_semi").select(F.col("a").alias("x"), F.col("p").alias("y"))
    both = across.unionByName(chained).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    settled = _core(both)
    label = settled.select(F.col("a").alias("p"), F.col("b").alias("label"))
    of = lambda df: df.join(label, "p", "left").select("id", F.coalesce("label", "p").alias("label"))
    hung = of(up.join(held.withColumnRenamed("b", "a"), "a", "left_anti").select(F.col("a").alias("id"), "p"))
    return hung.unionByName(of(held.select(F.col("b").alias("id"), F.col("b").alias("p"))))
