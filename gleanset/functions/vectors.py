"""Vector functions over ``array<double>`` columns, all JVM-side.

Sums run in element order, so that results don't depend on partitioning. Where the first of equal values
counts (argmax, argmin), it is the one with the lowest index.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return vsum(a) / F.size(a)


def std_pop(a: Column) -> Column:
    m = mean(a)
    return F.sqrt(F.greatest(vsum(F.transform(a, lambda x: x * x)) / F.size(a) - m * m, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_dist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance from differences (never by norm expansion, which cancels)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def clip(a: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    """NaN and null become 0, infinities the bound."""
    return F.transform(a, lambda x: F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))))


def l2_normalised(a: Column, least: float = 1e-12) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n < least, 1.0).otherwise(n))


def sum_normalised(a: Column) -> Column:
    """Each value over the sum; a vector that sums to 0 stays."""
    s = vsum(a)
    return F.transform(a, lambda x: x / F.when(s == 0, 1.0).otherwise(s))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    return sum_normalised(F.transform(a, lambda x: F.exp(x - top)))


def one_hot(label: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def at(a: Column, index: Column | int) -> Column:
    """Element by index from 0."""
    return F.element_at(a, (F.lit(index) if isinstance(index, int) else index) + 1)


def cross_entropy(p: Column, q: Column) -> Column:
    """-sum q log p, with p cut at 1e-12."""
    return -F.aggregate(F.zip_with(p, q, lambda x, y: y * F.ln(F.greatest(x, F.lit(1e-12)))), F.lit(0.0), lambda s, x: s + x)


def outer(a: Column, b: Column) -> Column:
    """All products a_i * b_j, row by row."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def column_aggregates(features: str, d: int, of: Callable[[Column], Column]) -> Column:
    """One aggregate for each of d positions, as an array: a single pass without exploding rows."""
    return F.array(*[of(F.col(features)[i]) for i in range(d)])
