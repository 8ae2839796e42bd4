"""The engine's one relation: points(row_id bigint, features array<double>, label int)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanset.functions.vectors import doubles


def points(df: DataFrame, row_id: str, features: str | list[str], label: str) -> DataFrame:
    """Points from any table: an array column, or several numeric columns, as features."""
    f = doubles(F.col(features)) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    return df.select(F.col(row_id).cast("bigint").alias("row_id"), f.alias("features"), F.col(label).cast("int").alias("label"))


def embeddings(spark, sf_dir: str) -> DataFrame:
    return points(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")


def dimensions(df: DataFrame) -> int:
    """Length of the feature vectors, from one row."""
    row = df.select(F.size("features").alias("d")).head()
    return row["d"] if row else 0


def dense_labels(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Sorted distinct values to 0..C-1. Only the distinct values are ranked; the dictionary is joined back."""
    values = df.select(F.col(column).alias("__v")).where("__v IS NOT NULL").distinct()
    ids = values.select("__v", (F.row_number().over(Window.orderBy("__v")) - 1).alias(out))
    return df.join(ids, F.col(column) == F.col("__v"), "left").drop("__v")


def lineitem_points(spark, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")]))
    df = li.withColumn("row_id", F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint"))
    return points(dense_labels(df, "l_returnflag"), "row_id", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "label")
