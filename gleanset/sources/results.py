"""What a method hands over: chosen rows with weights, corrections, history and metadata."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _matched(points: DataFrame, other: DataFrame, what: str) -> DataFrame:
    """``other``, if it holds every row_id of the points once and no other."""
    both = points.groupBy("row_id").agg(F.count(F.lit(1)).alias("__a")).join(other.groupBy("row_id").agg(F.count(F.lit(1)).alias("__b")), "row_id", "full")
    if not both.where("__a IS DISTINCT FROM 1 OR __b IS DISTINCT FROM 1").isEmpty():
        raise ValueError(f"{what} must have one row for each point")
    return other


def training_rows(points: DataFrame, selected: DataFrame | None = None, labels: DataFrame | None = None, features: DataFrame | None = None, soft: DataFrame | None = None) -> DataFrame:
    """(row_id, features, label, soft, sample_weight) of the rows to train on.

    ``selected`` (row_id[, sample_weight]): all rows, of weight 1, by default. ``labels``, ``features`` and ``soft``
    (row_id and that column) correct all points and replace theirs before rows are chosen; a null keeps the point's own.
    Soft targets are divided by their sum, unless it is 0.
    """
    out = points.select("row_id", "features", "label")
    for name, fix in (("features", features), ("label", labels)):
        if fix is not None:
            fix = _matched(points, fix.select("row_id", F.col(name).alias("__fix")), f"corrected {name}")
            out = out.join(fix, "row_id", "left").withColumn(name, F.coalesce("__fix", name)).drop("__fix")
    if soft is None:
        out = out.withColumn("soft", F.lit(None).cast("array<double>"))
    else:
        out = out.join(_matched(points, soft.select("row_id", "soft"), "soft targets"), "row_id", "left")
        total = F.aggregate("soft", F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("__s", F.when(total == 0, 1.0).otherwise(total)).withColumn("soft", F.transform("soft", lambda x: x / F.col("__s"))).drop("__s")
    if selected is None:
        return out.withColumn("sample_weight", F.lit(1.0))
    weight = F.col("sample_weight").cast("double") if "sample_weight" in selected.columns else F.lit(1.0)
    return out.join(selected.select("row_id", weight.alias("sample_weight")), "row_id")


def history(frames: list[DataFrame]) -> DataFrame:
    """All rows of the stages' reports; columns in the order first seen, null where a stage lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_output(rows: DataFrame, path: str, metadata: dict, arrays: bool = True, overwrite: bool = False) -> None:
    """``path``/metadata as one line of JSON and, unless ``arrays`` is off, the rows as ``path``/rows."""
    mode = "overwrite" if overwrite else "errorifexists"
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(metadata, ensure_ascii=False),)], "value string").write.mode(mode).text(f"{path}/metadata")
    if arrays:
        rows.write.mode(mode).parquet(f"{path}/rows")


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])
