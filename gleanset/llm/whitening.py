"""Exact embedding whitening by residue-number scatter.

Entries become integers, so sums and the scatter matrix are integers too and can be had exactly, whatever the number of rows
and the partitioning. Three passes over the vectors, none of which shuffles rows:

1. counts, exact sums (in two halves that can't overflow) and the largest magnitude, by length of vector;
2. the scatter about an integer centre: every partition multiplies the residues of its rows modulo several primes
   (below 2**20, in blocks of 2**12 rows, so that double-precision GEMM is exact), adds the products modulo each prime, and
   sends one row for each prime and dimension. These are added by (prime, dimension); Chinese remaindering on the d x d sums gives
   the exact scatter, from which the covariance follows as a quotient of integers. Its eigenvectors are found in double precision;
3. the measured covariance of the whitened vectors.

Only matrices of d x d numbers reach the driver. Projecting is a fourth scan, row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import load

#: Entries are floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Magnitudes are held to this many bits: larger entries count as the bound.
MOST_BITS = 61
#: Primes stay below 2**PRIME_BITS and blocks at 2**BLOCK_BITS rows: products and their sums stay below 2**53.
PRIME_BITS, BLOCK_BITS = 20, 12
COMPONENTS = 32
#: Rows whitened at a time.
ROWS = 4096


def primes(least_product: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS whose product exceeds the bound."""
    out, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= least_product:
        if all(p % k for k in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of smallest magnitude with these residues."""
    x, m = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        x += m * ((r - x) * pow(m, -1, p) % p)
        m *= p
    return x - m if 2 * x > m else x


def integers(v: Column) -> Column:
    """Null for a vector that has no place: null, or with a null or non-finite entry."""
    c = v.cast("array<double>")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    top = float(1 << MOST_BITS)
    x = F.transform(c, lambda e: F.floor(F.least(F.greatest(e * SCALE, F.lit(-top)), F.lit(top))).cast("long") + OFFSET)
    return F.when(c.isNotNull() & ~bad, x)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, pos, high, low, n, least, most) of the vectors of a partition, by length d: the sum is high * 2**31 + low."""
    totals: dict[int, list[np.ndarray]] = {}
    for b in parts:
        column = b.column("x")
        size = np.asarray(pc.list_value_length(column))
        for d in np.unique(size[size > 0]).tolist():
            x = matrix(column.filter(pa.array(size == d)))
            # Of 2**29 rows at most: halves are below 2**31 and 2**33 in magnitude.
            new = [(x >> 31).sum(0), (x & (2**31 - 1)).sum(0), np.full(d, len(x)), x.min(0), x.max(0)]
            old = totals.get(d)
            totals[d] = [f(*v) for f, v in zip((np.add, np.add, np.add, np.minimum, np.maximum), zip(old, new, strict=True), strict=True)] if old else new
    for d, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), *map(pa.array, total)], ["d", "pos", "high", "low", "n", "least", "most"])


@dataclass
class Whitener:
    """What all rows share: counts, exact sums, the integer centre, and the eigensystem."""

    n: int
    sums: list[int]
    centre: list[int]
    scatter: list[list[int]]
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    @property
    def trace(self) -> float:
        d = len(self.sums)
        return float(Fraction(sum(self.n * self.scatter[i][i] - self.shifted[i] ** 2 for i in range(d)), self.n**2))

    @property
    def shifted(self) -> list[int]:
        """Sums about the centre."""
        return [s - self.n * m for s, m in zip(self.sums, self.centre, strict=True)]

    def covariance(self) -> np.ndarray:
        s, n = self.shifted, self.n
        return np.array([[float(Fraction(n * v - s[i] * s[j], n * n)) for j, v in enumerate(row)] for i, row in enumerate(self.scatter)])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors; 0 along components without variance."""
        rest = np.array([float(Fraction(s, self.n)) for s in self.shifted])
        y = (x - np.array(self.centre, np.int64)).astype(float) - rest
        # Each value is one sum in a fixed order, wherever the row stands in its batch.
        z = np.stack([np.einsum("ij,j->i", y, w) for w in self.vectors.T], 1) if self.vectors.shape[1] else np.zeros((len(y), 0))
        flat = self.values <= 0
        return np.where(flat, 0.0, z / np.sqrt(np.where(flat, 1.0, self.values)))

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n x - S)^2."""
        y, s, n = x - np.array(self.centre, np.int64), self.shifted, self.n
        far = int(np.abs(y).max(initial=0)) * n + max(map(abs, s), default=0)
        if len(s) * far * far < 2**63:
            return ((y * n - np.array(s, np.int64)) ** 2).sum(1).tolist()
        return [sum((n * v - t) ** 2 for v, t in zip(row, s, strict=True)) for row in y.tolist()]


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector has a place, of any length."""
    out = table.select(F.col(id_col).alias("vec_id"), integers(F.col(vector_col)).alias("x"))
    return out.where(F.col("x").isNotNull())


def summed(rows: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """Of the vectors of the commonest length (the larger of two): their number, and for each dimension the exact sum, the least and the most value."""
    parts = rows.select("x").mapInArrow(_sums, "d long, pos long, high long, low long, n long, least long, most long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    by_length = parts.groupBy("d", "pos").agg(*exact, F.min("least").alias("least"), F.max("most").alias("most"))
    best = by_length.groupBy("d").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "high", "low", "least", "most"))).alias("all")).orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return 0, [], [], []
    got = best["all"]
    return int(best["n"]), [int(r["high"]) * 2**31 + int(r["low"]) for r in got], [r["least"] for r in got], [r["most"] for r in got]


def scatter(rows: DataFrame, centre: list[int], bound: int) -> list[list[int]]:
    """The exact sums over rows of (x_i - m_i) (x_j - m_j). ``bound`` is at least the largest magnitude among them."""
    moduli = primes(2 * bound + 1)
    m, d, block = np.array(centre, np.int64), len(centre), 1 << BLOCK_BITS
    schema = pa.schema([("p", pa.int32()), ("i", pa.int32()), ("v", pa.list_(pa.int64()))])

    def products(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((len(moduli), d, d), np.int64), False
        for b in parts:
            x = matrix(b.column("x"))
            for a in range(0, len(x), block):
                y, any_row = x[a : a + block] - m, True
                for k, p in enumerate(moduli):
                    r = (y % p).astype(float)
                    total[k] = (total[k] + (r.T @ r).astype(np.int64) % p) % p
        if any_row:
            yield _batch([(k, i, total[k, i]) for k in range(len(moduli)) for i in range(d)], schema)

    def reduced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in parts:
            for p, i, v in zip(b.column("p").to_pylist(), b.column("i").to_pylist(), matrix(b.column("v")), strict=True):
                total[p, i] = (total.get((p, i), 0) + v) % moduli[p]
        if total:
            yield _batch([(*k, v) for k, v in total.items()], schema)

    kind = "p int, i int, v array<long>"
    table = np.zeros((len(moduli), d, d), np.int64)
    for r in rows.select("x").mapInArrow(products, kind).repartition("p", "i").mapInArrow(reduced, kind).toLocalIterator():
        table[r["p"], r["i"]] = r["v"]
    out = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i + 1):
            out[i][j] = out[j][i] = remaindered([int(v) for v in table[:, i, j]], moduli)
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener:
    """The whitener of the (vec_id, x) rows of the commonest length; n is 0 without any."""
    n, sums, least, most = summed(rows)
    if not n:
        return Whitener(0, [], [], [], np.zeros(0), np.zeros((0, 0)))
    rows = rows.where(F.size("x") == len(sums))
    centre = [round(Fraction(s, n)) for s in sums]
    far = max((max(b - m, m - a) for a, b, m in zip(least, most, centre, strict=True)), default=0)
    w = Whitener(n, sums, centre, scatter(rows, centre, n * far * far), np.zeros(0), np.zeros((len(sums), 0)))
    e, u = np.linalg.eigh(w.covariance())
    order = np.argsort(-e, kind="stable")[:components]
    e = e[order]
    # Double precision can't tell these from 0.
    w.values, w.vectors = np.where(e <= max(e.max(initial=0), 0) * len(sums) * np.finfo(float).eps, 0.0, e), u[:, order]
    w.identity_error = measured_error(rows, w)
    return w


def measured_error(rows: DataFrame, w: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    use = np.flatnonzero(w.values > 0)
    k = len(use)
    if not k:
        return 0.0
    schema = pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("about", pa.list_(pa.float64()))])

    def merged(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, about = 0, np.zeros(k), np.zeros((k, k))
        for m, b, c in parts:
            if m:
                step = b - mean
                about += c + np.outer(step, step) * (n * m / (n + m))
                mean, n = mean + step * (m / (n + m)), n + m
        return n, mean, about

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for b in parts:
            x = matrix(b.column("x"))
            for a in range(0, len(x), ROWS):
                z = w.project(x[a : a + ROWS])[:, use]
                c = z - z.mean(0)
                yield len(z), z.mean(0), c.T @ c

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, about = merged(blocks(parts))
        if n:
            yield _batch([(n, mean, about.ravel())], schema)

    got = rows.select("x").mapInArrow(each, "n long, mean array<double>, about array<double>").toLocalIterator()
    n, _, about = merged((r["n"], np.array(r["mean"]), np.array(r["about"]).reshape(k, k)) for r in got)
    return float(np.abs(about / n - np.eye(k)).max())


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that has a place: vec_id, n, deviation, deviation_text, whitened and explained (arrays by component), identity_error.

    Components are the unit eigenvectors of the integer vectors' covariance by falling eigenvalue, ``components`` of them at most.
    deviation is null where it doesn't fit into a long; deviation_text has its digits always.

    Defined cases: a vector that is null or holds a null, NaN or infinity is dropped; so are vectors of another length than
    the commonest (the larger of equally common ones), and empty ones; entries are held to 2**61 / 64 in magnitude; along a component
    without variance (one vector, repeated vectors, constant dimensions) whitened and explained are 0, and identity_error
    looks at the others; null and repeated ids are rows like any other; other columns aren't looked at; an empty table gives no rows.
    """
    rows = vectors_of(table, id_col, vector_col)
    w = fit(rows, components)
    rows = rows.where(F.size("x") == len(w.sums)) if w.n else rows.where("false")
    id_type = rows.schema["vec_id"].dataType.simpleString()
    kind = f"vec_id {id_type}, n long, deviation long, deviation_text string, whitened array<double>, explained array<double>, identity_error double"
    share = [float(v / w.trace) if v > 0 else 0.0 for v in w.values]

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for a in range(0, b.num_rows, ROWS):
                part = b.slice(a, ROWS)
                x = matrix(part.column("x"))
                far, z = w.deviation(x), w.project(x)
                width = z.shape[1]
                at = pa.array(np.arange(len(z) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"), pa.array(np.full(len(z), w.n)), pa.array([v if v < 2**63 else None for v in far], pa.int64()), pa.array(map(str, far), pa.string()),
                        pa.ListArray.from_arrays(at, pa.array(z.ravel())), pa.ListArray.from_arrays(at, pa.array(np.tile(share, len(z)))), pa.array(np.full(len(z), w.identity_error)),
                    ],
                    ["vec_id", "n", "deviation", "deviation_text", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(load(spark, sf_dir, "embeddings"))
    both = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c")
    return out.select("vec_id", "n", "deviation", "identity_error", both).select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )
