"""Connected components of a graph of bigint ids, by alternating large and small stars.

Each round is two joins and two aggregates with partial aggregation; the edges are written to the shared
folder after each round. No vertex's neighbours meet in one task: a hub's edges are rows of a join that
Spark may split. A graph whose counted edges are ``IN_ONE_TASK`` at most (some 32 MB) is solved by union-find in
one task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch


IN_ONE_TASK = 1 << 21


def _union_find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), all in one task, to (id, component)."""
    edges = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()], 1) for b in parts if b.num_rows]
    if not edges:
        return
    ids, place = np.unique(np.concatenate(edges), return_inverse=True)
    place = place.reshape(-1, 2)
    root = np.arange(len(ids))
    while True:
        # Both ends take the smaller root, then paths are halved until all roots are their own.
        low = np.minimum(root[place[:, 0]], root[place[:, 1]])
        new = root.copy()
        for k in (0, 1):
            np.minimum.at(new, root[place[:, k]], low)
            np.minimum.at(new, place[:, k], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "component"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # Edges lead from the larger to the smaller id.
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(id, component) of every id with an edge to another; component is the smallest id that is reachable.

    ``edges`` has two bigint columns a, b; loops and repeated edges don't matter.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark, k = work.keep(start, f"{name}-0"), None, 0
    if now.count() <= IN_ONE_TASK:
        return work.keep(now.coalesce(1).mapInArrow(_union_find, "id long, component long"), f"{name}-labels")
    while True:
        mine = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mine == mark or not mine[0]:
            break
        mark, k = mine, k + 1
        now = work.keep(_small_star(_large_star(now)), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
    # At rest every edge leads from an id to its component.
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
