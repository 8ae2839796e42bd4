"""Seeded samples, splits and folds with exact sizes, by hash order.

Global ranks don't sort the table in one task: rows are counted by hash prefix (a table of at most 65,536
rows), and ranks inside a prefix come from a window over that prefix alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanset.functions.hashing import hash_order
from gleanset.operators import stats


def global_rank(df: DataFrame, row_id: str, salt: int | str, out: str = "rank") -> DataFrame:
    """Adds the 1-based rank of each row in hash order."""
    h = df.withColumn("__h", hash_order(row_id, salt)).withColumn("__p", F.substring("__h", 1, 4))
    counts = h.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).alias("__b"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy("__h", row_id))
    return h.join(F.broadcast(before), "__p").select(*df.columns, (F.coalesce("__b", F.lit(0)) + within).alias(out))


def exact_sample(df: DataFrame, row_id: str, n: int, salt: int | str) -> DataFrame:
    """n rows without replacement."""
    return global_rank(df, row_id, salt, "__rank").where(F.col("__rank") <= n).drop("__rank")


def class_ranked(df: DataFrame, label: str, row_id: str, salt: int | str) -> DataFrame:
    """Adds __place in hash order within the label, and __n, the label's rows."""
    sizes = stats.group_sizes(df, label).select(F.col(label).alias("__label"), F.col("n").alias("__n"))
    ranked = stats.ranked(df, label, hash_order(row_id, salt), F.asc(row_id), name="__place")
    return ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("__label"))).drop("__label")  # as many rows as labels


def stratified_split(df: DataFrame, label: str, row_id: str, salt: int | str = 42, train: float = 0.8) -> DataFrame:
    """Adds ``split``: of each label floor(train * n) rows, 1 to n - 1 of them if it has more than one."""
    n = F.col("__n")
    k = F.when(n > 1, F.greatest(F.lit(1), F.least(n - 1, F.floor(n * train)))).otherwise(n)
    return class_ranked(df, label, row_id, salt).select(*df.columns, F.when(F.col("__place") <= k, "train").otherwise("test").alias("split"))


def kfold(df: DataFrame, label: str, row_id: str, folds: int, salt: int | str = 42) -> DataFrame:
    """Adds ``fold``: stratified, as many folds as the smallest class allows, 2 at least."""
    least = stats.group_sizes(df, label).agg(F.min("n")).first()[0] or 0
    k = min(max(2, folds), max(2, least))
    ranked = stats.ranked(df, label, hash_order(row_id, salt), F.asc(row_id), name="__place")
    return ranked.select(*df.columns, ((F.col("__place") - 1) % k).cast("int").alias("fold"))


def trial_subsets(df: DataFrame, row_id: str, trials: int, k: int, salt: int | str = 0) -> DataFrame:
    """(trial, row_id): k rows for each trial, drawn independently."""
    out = None
    for t in range(trials):
        one = exact_sample(df.select(row_id), row_id, k, f"{salt}|{t}").select(F.lit(t).alias("trial"), row_id)
        out = one if out is None else out.union(one)
    return out
