"""Approximate nearest representative by one descent of a k-d tree.

A node of more than ``leaf`` representatives is split at the median of the dimension in which they vary most; a row goes down
one path and takes the nearest representative of the leaf it ends in, so its cost grows with the logarithm of the coreset.

A coreset of at most ``MOST_VALUES`` numbers is a tree that is sent to the workers. Of a larger one the upper levels are split
in Spark, level by level, until nodes are that small; rows go down to such a node in their scan, meet its representatives
in a task (rows of a crowded node are dealt over several), and descend the node's own tree there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanset.functions import vectors as V
from gleanset.operators import neighbours
from gleanset.operators.distance import kinds
from gleanset.operators.neighbours import ROWS, matrix
from gleanset.operators.scratch import checkpointed

#: Numbers (rows times width) of representatives that one tree is made of in memory.
MOST_VALUES = 1 << 20
LEAF = 64
#: Representatives that vary less than this aren't split.
LEAST_VARIANCE = 1e-12


@dataclass
class Tree:
    """Nodes as arrays: an inner node has a dimension, a cut and two children; a leaf (dimension -1) has rows ``first`` to ``last``."""

    dim: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)

    def add(self) -> int:
        for column, value in zip((self.dim, self.cut, self.left, self.right, self.first, self.last), (-1, 0.0, -1, -1, 0, 0), strict=True):
            column.append(value)
        return len(self.dim) - 1

    def split(self, node: int, dim: int, cut: float) -> tuple[int, int]:
        self.dim[node], self.cut[node] = dim, cut
        self.left[node], self.right[node] = self.add(), self.add()
        return self.left[node], self.right[node]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row's descent ends: to the left where its value is at most the cut."""
        dim, cut, left, right = (np.array(v) for v in (self.dim, self.cut, self.left, self.right))
        at, on = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(on := on[dim[at[on]] >= 0]):
            n = at[on]
            at[on] = np.where(x[on, dim[n]] <= cut[n], left[n], right[n])
        return at


def built(y: np.ndarray, ids: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The tree of some representatives, and their vectors and ids in the order of its leaves (by id in each)."""
    tree, order, todo = Tree(), np.argsort(ids, kind="stable"), []
    todo.append((tree.add(), order))
    leaves, at = [], 0
    while todo:
        node, rows = todo.pop()
        spread = y[rows].var(0) if len(rows) > leaf else np.zeros(1)
        if spread.max(initial=0) <= LEAST_VARIANCE:
            rows = rows[np.argsort(ids[rows], kind="stable")]
            tree.first[node], tree.last[node] = at, at + len(rows)
            at += len(rows)
            leaves.append(rows)
            continue
        dim = int(spread.argmax())
        rows = rows[np.lexsort((ids[rows], y[rows, dim]))]
        half = len(rows) // 2
        a, b = tree.split(node, dim, float(y[rows[half], dim]))
        todo += [(b, rows[half:]), (a, rows[:half])]
    order = np.concatenate(leaves)
    return tree, y[order], ids[order]


def descended(x: np.ndarray, held: tuple[Tree, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position, d2) of the nearest representative in each row's leaf; of equally near ones that of the smallest id."""
    tree, y, _ = held
    at, pos, best = tree.leaf_of(x), np.zeros(len(x), np.int64), np.zeros(len(x))
    order = np.argsort(at, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        if len(rows):
            a, b = tree.first[at[rows[0]]], tree.last[at[rows[0]]]
            d = ((x[rows][:, None] - y[a:b]) ** 2).sum(2)
            k = d.argmin(1)
            pos[rows], best[rows] = a + k, d[np.arange(len(k)), k]
    return pos, best


def upper_levels(reps: DataFrame, width: int, most: int) -> tuple[Tree, DataFrame]:
    """The tree down to nodes of at most ``most`` representatives, and ``reps`` with the ``block`` (node) they are in.

    A level is one job for the variances and one for the median rows: values are dealt into ranges of (node, value, id), whose counts
    say in which range and at which place a node's median is. The driver holds nodes, not rows.
    """
    tree = Tree()
    tree.add()
    state = checkpointed(reps.withColumn("block", F.lit(0).cast("long")))
    while True:
        stats = state.groupBy("block").agg(F.count(F.lit(1)).alias("n"), V.column_aggregates("features", width, F.var_pop).alias("spread"))
        large = {r["block"]: (r["n"], int(np.argmax(r["spread"]))) for r in stats.where(F.col("n") > most).collect() if max(r["spread"]) > LEAST_VARIANCE}
        if not large:
            return tree, state
        spark = reps.sparkSession
        nodes = spark.createDataFrame([(b, dim) for b, (_, dim) in large.items()], "block long, dim int")
        values = state.join(F.broadcast(nodes), "block").select("block", V.at(F.col("features"), F.col("dim")).alias("v"), "row_id")
        dealt = checkpointed(values.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "v", "row_id").withColumn("range", F.spark_partition_id()))
        before, wanted = dict.fromkeys(large, 0), []
        for r in dealt.groupBy("range", "block").count().orderBy("range").collect():
            half, seen = large[r["block"]][0] // 2, before[r["block"]]
            if seen <= half < seen + r["count"]:
                wanted.append((r["range"], r["block"], half - seen + 1))
            before[r["block"]] += r["count"]
        place = F.row_number().over(Window.partitionBy("range", "block").orderBy("v", "row_id"))
        medians = dealt.join(F.broadcast(spark.createDataFrame(wanted, "range int, block long, place int")), ["range", "block"]).withColumn("k", place).where("k = place").collect()
        cuts = [(r["block"], large[r["block"]][1], r["v"], r["row_id"], *tree.split(r["block"], large[r["block"]][1], r["v"])) for r in medians]
        moved = state.join(F.broadcast(spark.createDataFrame(cuts, "block long, dim int, v double, id long, l long, r long")), "block", "left")
        value = V.at(F.col("features"), F.col("dim"))
        low = (value < F.col("v")) | ((value == F.col("v")) & (F.col("row_id") < F.col("id")))
        state = checkpointed(moved.withColumn("block", F.when(F.col("dim").isNull(), F.col("block")).when(low, F.col("l")).otherwise(F.col("r"))).select(state.columns))


def kd_nearest(points: DataFrame, reps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``points`` with rep_id and d2 of the nearest row of ``reps`` (row_id, features) in the leaf of one descent; null without any.

    Rows have unique ids and vectors of one length, without missing numbers.
    """
    leaf = max(1, leaf)
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    n, width = size["n"], size["d"] or 0
    if not n:
        return points.withColumns({"rep_id": F.lit(None).cast("bigint"), "d2": F.lit(None).cast("double")})
    most = max(leaf, MOST_VALUES // max(1, width))
    if n <= most:
        got = reps.select("row_id", "features").collect()
        held = built(np.array([r["features"] for r in got], float), np.array([r["row_id"] for r in got], np.int64), leaf)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                x = matrix(b.column("features"), width)
                each = [descended(x[a : a + ROWS], held) for a in range(0, len(x), ROWS)] or [(np.zeros(0, np.int64), np.zeros(0))]
                pos, d2 = (np.concatenate(v) for v in zip(*each, strict=True))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held[2][pos]), pa.array(d2)], [*b.schema.names, "rep_id", "d2"])

        return points.mapInArrow(run, f"{kinds(points)}, rep_id bigint, d2 double")

    doubles = F.col("features").cast("array<double>").alias("features")
    top, placed = upper_levels(reps.select(F.col("row_id").cast("long").alias("row_id"), doubles), width, most)

    def down(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top.leaf_of(matrix(b.column("features"), width))), pa.array(np.zeros(b.num_rows))], [*b.schema.names, "block", "bound"])

    def compare(x: np.ndarray, own: np.ndarray, bound: np.ndarray, held: tuple) -> tuple:
        pos, d2 = descended(x, held)
        return np.arange(len(x)), held[2][pos], d2, [0] * len(x)

    visitors = points.select(F.col("row_id").cast("long").alias("row_id"), doubles).mapInArrow(down, "row_id long, features array<double>, block long, bound double")
    found = neighbours.met(placed.withColumn("label", F.lit(0)), visitors, width, lambda y, ids, _: built(y, ids, leaf), compare)
    one = F.element_at("neighbours", 1)
    return points.join(found.select("row_id", one["row_id"].alias("rep_id"), one["d2"].alias("d2")), "row_id", "left")
