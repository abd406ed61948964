"""Connected components of a graph of any size: local forests first, then alternating large and small stars.

The edges are dealt into as many tasks as a bounded number of edges each needs; a
union-find in each task turns its edges into stars around their smallest node.
Where one task holds all edges, that is the answer; otherwise rounds of large and
small stars join the tasks' stars.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Rounds after which a graph that still changes is an error; a path of n nodes takes about log2(n).
ROUNDS = 60
#: Edges of a task, 32 MB.
EDGES = 2_000_000


class Forest:
    """Union-find that keeps the smallest node of each tree at its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def joins(self, a: int, b: int) -> bool:
        """Whether the edge joins two trees, which are one from then on."""
        x, y = self.top(a), self.top(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spanning(u: Iterable[int], v: Iterable[int]) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    forest = Forest()
    return [(a, b) for a, b in zip(u, v, strict=True) if forest.joins(a, b)]


def local_stars(table: pa.Table) -> pa.Table:
    """(u, v): every node of a task's edges but the roots, with its root."""
    pairs = np.stack([table.column("u").to_numpy(), table.column("v").to_numpy()], axis=1)
    # equal edges side by side, so that only the first of them is looked at
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]] if len(pairs) else pairs
    forest = Forest()
    for a, b in zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), strict=True):
        forest.joins(a, b)
    nodes = list(forest.up)
    return pa.table({"u": pa.array(nodes, pa.int64()), "v": pa.array([forest.top(x) for x in nodes], pa.int64())})


def connected_components(edges: DataFrame, name: str = "components", most: int = EDGES) -> DataFrame:
    """(node, root) of every node but the roots, of edges (u, v); root is the smallest node of its component.

    Each round is written to the shared folder, so no lineage grows. Nulls and loops are left out.
    """
    pairs = edges.where("u is not null and v is not null and u <> v")
    pairs = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), name)
    tasks = max(1, -(-pairs.count() // most))
    pairs = written(pairs.groupBy(F.pmod(F.xxhash64("u"), F.lit(tasks)).alias("task")).applyInArrow(local_stars, "u long, v long"), name)
    before = None
    for _ in range(ROUNDS if tasks > 1 else 0):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs = written(small.where("u <> v").distinct(), name)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        if tasks > 1:
            raise RuntimeError(f"components still change after {ROUNDS} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
