"""Nearest-representative joins and the weights that follow from them.

Distances are sums of squared differences (norm expansion cancels), and ties go to the smallest id. A coreset of at most
``MOST_VALUES`` numbers is sent to the workers; a larger one, and every pool of neighbours, is joined by pivots
(``neighbours``), without passing through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.functions import vectors as V
from gleanset.operators import neighbours
from gleanset.operators.scratch import checkpointed

#: Numbers (rows times width) of representatives that may be sent to workers.
MOST_VALUES = 1 << 20
#: Rows that are compared with a block at a time, and products that are held meanwhile (they stay in the cache).
ROWS, TILE = 256, 1 << 17


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def sq_dists(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(1) for c in y], 1) if len(y) else np.zeros((len(x), 0))


class Screen:
    """What vectors may gain by others, from above: a product's rounding is added, so that no positive gain is missed."""

    def __init__(self, x: np.ndarray, extra: np.ndarray, kind=float):
        n, self.d = x.shape
        self.b, self.eps = np.empty((self.d + 2, n), kind), float(np.finfo(kind).eps)
        self.b[: self.d], self.b[self.d + 1] = x.T, 1.0
        self.own = (x * x).sum(1) + extra
        self.scale = float(np.abs(self.own).max(initial=0.0) + np.abs(extra).max(initial=0.0))

    def _left(self, best: np.ndarray, y: np.ndarray, extra: np.ndarray) -> np.ndarray:
        size = (y * y).sum(1) + extra
        scale = self.scale + float(np.abs(size).max(initial=0.0) + np.abs(extra).max(initial=0.0) + np.abs(best).max(initial=0.0))
        self.b[self.d] = best - self.own + 8 * (self.d + 8) * self.eps * scale
        return np.column_stack([2 * y, np.ones(len(y)), -size]).astype(self.b.dtype, copy=False)

    def above(self, best: np.ndarray, y: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """At least max(best - |x - y|^2 - extras, 0), a line for each of ``y``; ``best`` is finite."""
        out = self._left(best, y, extra) @ self.b
        return np.maximum(out, 0, out=out)

    def sums(self, best: np.ndarray, w: np.ndarray, y: np.ndarray, extra: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """At least the sums of w * ``above``, and if ``count`` how many are positive, for each of ``y``."""
        left, total, hits, step = self._left(best, y, extra), np.zeros(len(y)), np.zeros(len(y)), max(1, TILE // max(1, len(best)))
        w = (w * (1 + 4 * (len(w) + 8) * self.eps)).astype(self.b.dtype, copy=False)
        held = np.empty((step, len(w)), self.b.dtype)
        for a in range(0, len(y), step):
            out = held[: min(step, len(y) - a)]
            np.matmul(left[a : a + step], self.b, out=out)
            np.maximum(out, 0, out=out)
            total[a : a + step] = out @ w
            if count:
                hits[a : a + step] = np.count_nonzero(out, axis=1)
        return total, hits


def _nearest_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of ``y`` to each of ``x``, and the squared distance: products leave out what is farther for sure, the rest is compared."""
    if len(y) < ROWS or not (np.isfinite(x).all() and np.isfinite(y).all()):
        d = sq_dists(x, y)
        k = d.argmin(1)
        return k, d[np.arange(len(k)), k]
    x2, step = (x * x).sum(1), max(1, TILE // max(1, len(x)))
    size = (y * y).sum(1)
    slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (x2 + size.max())
    most, of, at = np.full(len(x), np.inf), [], []
    for a in range(0, len(y), step):
        # The distance less |x|^2.
        d = x @ (-2 * y[a : a + step].T)
        d += size[a : a + step]
        np.minimum(most, d.min(1) + 2 * slack, out=most)
        row, col = np.nonzero(d <= most[:, None])
        of.append(row)
        at.append(col + a)
    of, at = np.concatenate(of), np.concatenate(at)
    d = ((x[of] - y[at]) ** 2).sum(1)
    order = np.lexsort((at, d, of))
    first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
    return at[first], d[first]


def nearest(points: DataFrame, reps: DataFrame) -> DataFrame:
    """``points`` with rep_id and d2 of the nearest row of ``reps`` (row_id, features); null without any.

    Up to ``MOST_VALUES`` numbers of representatives go to the workers as they are, and rows stay where they are; more of them
    are joined by pivots, with the same result.
    """
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    if size["n"] * max(1, size["d"] or 0) > MOST_VALUES:
        found = neighbours.knn(points, reps.select("row_id", "features", F.lit(0).alias("label")), 1, False, checkpointed)
        one = F.element_at("neighbours", 1)
        return points.join(found.select("row_id", one["row_id"].alias("rep_id"), one["d2"].alias("d2")), "row_id", "left")
    got = reps.select("row_id", "features").orderBy("row_id").collect()
    ids, y = np.array([r["row_id"] for r in got], np.int64), np.array([r["features"] for r in got], float)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = matrix(b.column("features"))
            rep, best = np.zeros(len(x), np.int64), np.zeros(len(x))
            for a in range(0, len(x), ROWS):
                k, best[a : a + ROWS] = _nearest_of(x[a : a + ROWS], y)
                rep[a : a + ROWS] = ids[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rep), pa.array(best)], [*b.schema.names, "rep_id", "d2"])

    if not got:
        return points.withColumns({"rep_id": F.lit(None).cast("bigint"), "d2": F.lit(None).cast("double")})
    return points.mapInArrow(run, f"{kinds(points)}, rep_id bigint, d2 double")


def representative_weights(mapped: DataFrame, reps: DataFrame, weight: str | None = None, floor: float | None = None) -> DataFrame:
    """(rep_id, sample_weight): the weight mass mapped to each representative; 0 (or ``floor``) without any."""
    mass = mapped.groupBy("rep_id").agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w"))
    w = F.coalesce("w", F.lit(0.0))
    if floor is not None:
        w = F.when(w <= 0, floor).otherwise(w)
    return reps.select(F.col("row_id").alias("rep_id")).join(mass, "rep_id", "left").select("rep_id", w.alias("sample_weight"))


def coreset_error(points: DataFrame, gradient: str, coreset: DataFrame, weight: str | None = None) -> DataFrame:
    """(gradient_error, weight_error) of weighted representatives against all rows.

    ``coreset`` has rep_id and sample_weight; gradients of representatives are their rows' in ``points``.
    """
    d = len(points.select(gradient).head()[0])
    w = F.col(weight) if weight else F.lit(1.0)
    total = lambda df, k: df.agg(F.array(*[F.sum(k * F.col(gradient)[i]) for i in range(d)]).alias("g"), F.sum(k).alias("w"))
    full = total(points, w).select(F.col("g").alias("fg"), F.col("w").alias("fw"))
    part = total(points.join(coreset.withColumnRenamed("rep_id", "row_id"), "row_id"), F.col("sample_weight")).select(F.col("g").alias("sg"), F.col("w").alias("sw"))
    one = full.join(part)  # a row and a row
    return one.select((V.norm(V.sub(F.col("fg"), F.col("sg"))) / (V.norm(F.col("fg")) + 1e-12)).alias("gradient_error"), (F.abs(F.col("fw") - F.col("sw")) / (F.abs("fw") + 1e-12)).alias("weight_error"))


def nearest_k(points: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """``points`` with ``neighbours``: the k nearest rows of the pool as (d2, row_id, label), itself left out."""
    found = neighbours.knn(points, pool, k, True, checkpointed)
    return points.join(found, "row_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.expr(f"cast(array() AS {neighbours.NEIGHBOURS})")))
