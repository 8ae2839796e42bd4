"""Aggregates over points: per position without exploding rows, and over small label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanset.functions import vectors as V
from gleanset.operators.scratch import checkpointed
from gleanset.sources.points import dimensions


#: Rows of one group that are sorted in one task.
ONE_TASK = 200_000


def width(points: DataFrame) -> int:
    return dimensions(points)


def mean_std(points: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation of each position."""
    d = width(points)
    if not d:
        return [], []
    r = points.agg(V.column_aggregates("features", d, F.avg).alias("m"), V.column_aggregates("features", d, F.stddev_pop).alias("s")).first()
    return list(r["m"]), list(r["s"])


def bounds(points: DataFrame) -> tuple[list[float], list[float], list[float]]:
    """Minimum, maximum and population deviation of each position."""
    d = width(points)
    r = points.agg(*[V.column_aggregates("features", d, f).alias(n) for n, f in (("lo", F.min), ("hi", F.max), ("s", F.stddev_pop))]).first()
    return list(r["lo"]), list(r["hi"]), list(r["s"])


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def mode(df: DataFrame, column: str) -> DataFrame:
    """(value, n): the most frequent value; ties go to the smallest."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1).select(F.col(column).alias("value"), "n")


def quantiles(df: DataFrame, column: str, qs: list[float], by: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, of the whole table or of each value of ``by``; nulls don't count.

    Distinct values are counted and dealt into ranges of (group, value); counts of the ranges before tell a range its first place, so
    that no task holds a group. Of each group only the two values around each quantile are gathered.
    """
    keys = [by] if by else []
    group = F.col(by) if by else F.lit(0)
    counted = df.groupBy(group.alias("__by"), F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(counted.repartitionByRange(ranges, "__by", "__v").withColumn("__range", F.spark_partition_id()))
    seen = dealt.where("__v IS NOT NULL")
    # A row for each range and group in it.
    earlier = Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = seen.groupBy("__range", "__by").agg(F.sum("__n").alias("__in"))
    sums = sums.select("__range", "__by", F.coalesce(F.sum("__in").over(earlier), F.lit(0)).alias("__before"), F.sum("__in").over(Window.partitionBy("__by")).alias("__all"))
    sums = sums.select(F.col("__range").alias("__r"), F.col("__by").alias("__g"), "__before", "__all")
    placed = seen.join(F.broadcast(sums), (F.col("__range") == F.col("__r")) & F.col("__by").eqNullSafe(F.col("__g")))
    inside = Window.partitionBy("__range", "__by").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("__end", F.col("__before") + F.sum("__n").over(inside))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__end") - F.col("__n") <= place) & (place < F.col("__end")), F.col("__v")))

    found = []
    for i, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("__all") - 1)
        found += [at(F.floor(place)).alias(f"__lo{i}"), at(F.ceil(place)).alias(f"__hi{i}"), F.max(place).alias(f"__at{i}")]
    values = []
    for i, q in enumerate(qs):
        lo, hi, place = F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(f"__at{i}")
        between = (F.ceil(place) - place) * lo + (place - F.floor(place)) * hi
        values.append(F.when(lo == hi, lo).otherwise(between).alias(f"q{round(q * 100)}"))
    found = placed.groupBy("__by").agg(*found)
    # Groups without any value, and an empty table, have null quantiles.
    groups = dealt.select("__by").distinct().withColumnRenamed("__by", "__g") if by else df.sparkSession.range(1).select(F.lit(0).alias("__g"))
    out = groups.join(found, F.col("__g").eqNullSafe(F.col("__by")), "left")
    return out.select(*[F.col("__g").alias(k) for k in keys], *values)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def macro_scores(df: DataFrame, truth: str, predicted: str, n_classes: int) -> DataFrame:
    """accuracy, macro precision, recall and F1 over labels 0..C-1; a division by 0 counts as 0."""
    c = confusion(df, truth, predicted).select(F.col(truth).alias("t"), F.col(predicted).alias("p"), "n")
    per = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("c"))
    tp = c.where("t = p").select(F.col("t").alias("c"), F.col("n").alias("tp"))
    row, col = c.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("nt")), c.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("np"))
    x = per.join(tp, "c", "left").join(row, "c", "left").join(col, "c", "left").na.fill(0, ["tp", "nt", "np"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("np")), share(F.col("tp"), F.col("nt"))
    x = x.select("tp", "nt", p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f"))
    return x.agg((F.sum("tp") / F.sum("nt")).alias("accuracy"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"))


def weighted_epoch_loss(df: DataFrame, epoch: str, loss: str, weight: str) -> DataFrame:
    return df.groupBy(epoch).agg((F.sum(F.col(loss) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-12))).alias("mean_loss"))


def group_sizes(df: DataFrame, by: str) -> DataFrame:
    """(by, n): a row for each group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, by: str, *order, name: str = "rank", largest: int | None = None) -> DataFrame:
    """Adds each row's place in its group, from 1. The order has to tell rows apart.

    Groups of at most ``ONE_TASK`` rows (``largest`` is counted if it isn't given) are sorted in a task each. Beyond, rows are dealt
    into ranges of (group, order), a range's rows are ranked, and the counts of the ranges before are added; the table of
    counts has a row for each range and group in it.
    """
    if largest is None:
        largest = group_sizes(df, by).agg(F.max("n")).first()[0] or 0
    if largest <= ONE_TASK:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(ranges, by, *order).withColumn("__range", F.spark_partition_id()))
    earlier = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("__range", by).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    before = before.select(F.col("__range").alias("__of"), F.col(by).alias("__by"), "__before")
    inside = dealt.withColumn("__in", F.row_number().over(Window.partitionBy("__range", by).orderBy(*order)))
    same = (F.col("__range") == F.col("__of")) & F.col(by).eqNullSafe(F.col("__by"))
    return inside.join(F.broadcast(before), same).select(*df.columns, (F.col("__in") + F.col("__before")).cast("int").alias(name))


def deduped(df: DataFrame, row_id: str, weight: str, position: str) -> DataFrame:
    """One row for each id: weights summed, first position kept."""
    return df.groupBy(row_id).agg(F.sum(weight).alias(weight), F.min(position).alias(position))


def early_stop(df: DataFrame, key: str, order: str, loss: str, patience: int, min_delta: float = 1e-4) -> DataFrame:
    """(key, best_loss, stopped_at): running best with patience, folded over each key's ordered losses.

    A key's losses (its epochs) are one array; improvement means falling under best - min_delta.
    """
    seq = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, loss))), lambda s: s[loss]).alias("l"))
    state = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(0).alias("n"), F.lit(0).alias("stop"))

    def fold(s: Column, x: Column) -> Column:  # noqa: F821
        better = x < s["best"] - min_delta
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        n = s["n"] + 1
        on = s["stop"] == 0
        return F.struct(F.when(on & better, x).otherwise(s["best"]).alias("best"), F.when(on, bad).otherwise(s["bad"]).alias("bad"), n.alias("n"), F.when(on & (bad >= patience), n).otherwise(s["stop"]).alias("stop"))

    return seq.select(key, F.aggregate("l", state, fold).alias("s")).select(key, F.col("s.best").alias("best_loss"), F.col("s.stop").alias("stopped_at"))


def recent_drop_stop(df: DataFrame, key: str, order: str, loss: str, window: int = 3, ratio: float = 1e-3) -> DataFrame:
    """(key, best_loss, steps, stopped): a descent ends where its last ``window`` drops are all at most ``ratio`` of the first loss.

    A key's losses are one array, folded in order; that all of the last drops are small is a count of small drops in a row.
    steps is the number of losses until the end (all of them if it isn't stopped), best_loss the least among these.
    """
    seq = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, loss))), lambda s: s[loss]).alias("l"))
    first = F.element_at("l", 1)
    state = F.struct(first.alias("last"), first.alias("best"), F.lit(0).alias("small"), F.lit(0).alias("n"))

    def fold(s, x):
        on = s["small"] < window
        small = F.when(s["n"] == 0, 0).when(s["last"] - x <= ratio * F.greatest(first, F.lit(1e-12)), s["small"] + 1).otherwise(0)
        return F.struct(x.alias("last"), F.when(on, F.least(s["best"], x)).otherwise(s["best"]).alias("best"), F.when(on, small).otherwise(s["small"]).alias("small"), F.when(on, s["n"] + 1).otherwise(s["n"]).alias("n"))

    out = seq.select(key, F.aggregate("l", state, fold).alias("s"))
    return out.select(key, F.col("s.best").alias("best_loss"), F.col("s.n").alias("steps"), (F.col("s.small") >= window).alias("stopped"))
