"""Connected components by alternating large and small stars, all in tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freeing, staged

CHUNK = 1_000_000
#: Edges, a few megabytes, that one task finishes at once; more go by rounds of joins.
FINISH = 250_000
#: A vertex of more edges than this, and than so many hubs leave room for, is a hub; so there are at most HUBS of them.
HUB_EDGES, HUBS = 1_000, 10_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and x != top:
            parent[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        self.parent.setdefault(low, low)
        return True

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of all that are not roots."""
        pairs = [(x, self.root(x)) for x in list(self.parent)]
        got = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
        return got[:, 0], got[:, 1]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as stars: at most one for each vertex of each CHUNK of edges."""
    forest, seen = Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        seen += batch.num_rows
        if seen >= CHUNK:
            yield _batch(*forest.edges())
            forest, seen = Forest(), 0
    yield _batch(*forest.edges())


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vertex and component of all edges of one partition."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    vertices = np.array(list(forest.parent), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(vertices), pa.array([forest.root(x) for x in vertices.tolist()], pa.int64())], names=["vertex", "component"])


def _tied(rows: DataFrame, edges: int) -> DataFrame:
    """rows (a, b) with m, the least b of each a. Minima are combined before the shuffle; hubs' rows meet theirs where they are, so none is a hot key."""
    low = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(HUB_EDGES, 2 * edges // HUBS)
    hubs = F.broadcast(low.filter(hub).drop("n"))  # HUBS rows at most
    return rows.join(hubs, "a").unionByName(rows.join(hubs, "a", "left_anti").join(low.filter(~hub).drop("n"), "a"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """vertex, component (its smallest vertex) of all vertices of edges (a, b). No edges: no rows.

    Each partition first turns its edges into stars. Then, until nothing changes or FINISH edges are left, each vertex's larger
    neighbours, then its smaller ones, are tied to the smallest vertex it knows; rounds grow as the logarithm of the
    longest path. Every round is a written table. Hubs are no hot keys, see `_tied`.
    """
    now = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(freeing(_contract), "a long, b long").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        n, told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n <= FINISH:
            return now.repartition(1).mapInArrow(freeing(_finished), "vertex long, component long")
        if told == before:
            break
        before = told
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _tied(both, 2 * n).select("a", "b", F.least("a", "m").alias("m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        small = _tied(down, 2 * n).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        last, now = now, staged(small, "edges")
        dropped(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("vertex"), "component").union(now.select("b", F.col("b").alias("component")).distinct())
