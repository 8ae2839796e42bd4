"""k-means in each of several groups at once: Lloyd's rounds whose only state in the driver are centres.

A round is one pass: tasks assign rows to the nearest centre of their group and add up each cluster, for all restarts
together. Starts are the first rows of a group in hash order, so the result is the same on every partitioning (up to the order of
sums). A cluster without rows keeps its centre; groups of fewer rows than clusters have a cluster for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanset.functions.hashing import hash_order
from gleanset.operators.distance import kinds, matrix
from gleanset.operators.scratch import gathered

Centres = dict[int, np.ndarray]
#: Squared distances are compared to so many digits, so that sums in another order give the same clusters.
DIGITS = 9


def starts(rows: DataFrame, k: int, salt: str) -> Centres:
    """By group the vectors of its first k rows in hash order. Groups are few; each gives k rows at most."""
    place = F.row_number().over(Window.partitionBy("group").orderBy(hash_order("row_id", salt), "row_id"))
    out: dict[int, list] = {}
    for r in rows.select("group", "v", place.alias("place")).where(F.col("place") <= k).orderBy("group", "place").collect():
        out.setdefault(r["group"], []).append(r["v"])
    return {g: np.array(v, float) for g, v in out.items()}


def _assigned(groups: np.ndarray, v: np.ndarray, centres: Centres) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of rows; of equally near centres the first."""
    at, far = np.zeros(len(v), np.int64), np.zeros(len(v))
    for g in np.unique(groups).tolist():
        on = np.flatnonzero(groups == g)
        d = np.round(np.stack([((v[on] - c) ** 2).sum(1) for c in centres[g]], 1), DIGITS)
        at[on] = d.argmin(1)
        far[on] = d[np.arange(len(on)), at[on]]
    return at, far


def _round(rows: DataFrame, tries: list[Centres]) -> tuple[list[Centres], list[dict[int, float]]]:
    """The centres after a round, and each group's inertia before it, for every try."""

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for b in parts:
            groups, v = np.asarray(b.column("group"), np.int64), matrix(b.column("v"))
            for t, centres in enumerate(tries):
                at, far = _assigned(groups, v, centres)
                for g, j in {*zip(groups.tolist(), at.tolist(), strict=True)}:
                    on = (groups == g) & (at == j)
                    new = [v[on].sum(0), int(on.sum()), float(far[on].sum())]
                    old = total.get((t, g, j))
                    total[t, g, j] = [a + c for a, c in zip(old, new, strict=True)] if old else new
        if total:
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*total, strict=True)), *(pa.array(list(c)) for c in zip(*total.values(), strict=True))], ["t", "g", "j", "s", "n", "far"])

    parts = rows.select("group", "v").mapInArrow(sums, "t long, g long, j long, s array<double>, n long, far double")
    new, inertia, held = [{g: c.copy() for g, c in centres.items()} for centres in tries], [dict.fromkeys(c, 0.0) for c in tries], {}
    for r in parts.toLocalIterator():  # tries x groups x clusters of each partition
        s, n = held.get((r["t"], r["g"], r["j"]), (0.0, 0))
        held[r["t"], r["g"], r["j"]] = s + np.array(r["s"]), n + r["n"]
        inertia[r["t"]][r["g"]] += r["far"]
    for (t, g, j), (s, n) in held.items():
        new[t][g][j] = s / n
    return new, inertia


def clustered(rows: DataFrame, k: int, restarts: int = 10, iterations: int = 100, salt: str = "kmeans") -> DataFrame:
    """``rows`` (row_id, group bigint, v array<double> of one length) with ``cluster``: of the restart with the least inertia in each group.

    Rounds end when no centre of any restart moves, or after ``iterations``.
    """
    tries, passes = [starts(rows, k, f"{salt}{t}") for t in range(restarts)], gathered(rows)
    for _ in range(iterations):
        new, _ = _round(passes, tries)
        still = all(np.array_equal(a[g], b[g]) for a, b in zip(tries, new, strict=True) for g in a)
        tries = new
        if still:
            break
    best = tries[0]
    if restarts > 1:
        _, inertia = _round(passes, tries)
        best = {g: tries[min(range(restarts), key=lambda t: (round(inertia[t][g], DIGITS), t))][g] for g in best}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            at, _ = _assigned(np.asarray(b.column("group"), np.int64), matrix(b.column("v")), best)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], [*b.schema.names, "cluster"])

    return rows.mapInArrow(run, f"{kinds(rows)}, cluster int")
