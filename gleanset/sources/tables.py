"""Readers of raw labelled tables, and the noisy-dataset layout.

Raw files are read with explicit schemas; layouts differ in separator, label column and how labels are given. Readers
return points and never infer types. Parquet partitioned by noise type, rate, dataset and split is the canonical store, so
that partition pruning does the path arithmetic.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset.sources.points import dense_labels


@dataclass(frozen=True)
class Layout:
    """Columns, label position and dropped positions of a headerless text table; ``separator`` None: white space."""

    columns: int
    label: int
    separator: str | None = ","
    drop: tuple[int, ...] = ()


# Layouts of public tabular datasets (columns, label position, separator, dropped positions).
LAYOUTS = {
    "wdbc": Layout(32, 1, ",", (0,)),
    "banknote": Layout(5, 4),
    "pendigits": Layout(17, 16),
    "magic": Layout(11, 10),
    "sensorless": Layout(49, 48, None),
    "skin": Layout(4, 3, None),
    "covertype": Layout(55, 54),
    "susy": Layout(19, 0),
}


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``row_id``: the position in file order, from one count per partition (no global sort)."""
    df = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    counts = sorted((r["__p"], r["count"], r["m"]) for r in df.groupBy("__p").agg(F.count(F.lit(1)).alias("count"), F.min("__m").alias("m")).collect())
    total, pairs = 0, []
    for p, n, m in counts:
        pairs += [F.lit(p), F.lit(total - m)]
        total += n
    return df.withColumn("row_id", F.col("__m") + (F.create_map(*pairs)[F.col("__p")] if pairs else F.lit(0))).drop("__p", "__m")


def read_table(spark: SparkSession, path: str | list[str], layout: Layout) -> DataFrame:
    """points from a headerless text table: strict numeric casts, labels to 0..C-1 in sorted order."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parts = F.split(F.trim("value"), r"\s+" if layout.separator is None else rf"\s*\{layout.separator}\s*")
    rows = numbered(lines.select(parts.alias("c"))).withColumn("c", F.when(F.size("c") == layout.columns, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("unexpected number of columns: "), F.size("c").cast("string"))).cast("array<string>")))
    keep = [i for i in range(layout.columns) if i != layout.label and i not in layout.drop]
    raw = rows.select("row_id", F.array(*[F.col("c")[i].cast("double") for i in keep]).alias("features"), F.col("c")[layout.label].alias("raw"))
    numeric = raw.select(F.max(F.expr("try_cast(raw AS double) IS NULL")).alias("text")).first()["text"]
    return dense_labels(raw if numeric else raw.withColumn("raw", F.col("raw").cast("double")), "raw").select("row_id", "features", F.col("label").cast("int").alias("label"))


def read_counted_signal(spark: SparkSession, path: str) -> DataFrame:
    """A white-space table whose first line gives the numbers of signal and background rows: label 1, then 0, by position."""
    rows = numbered(spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("c")))
    head = rows.where("row_id = 0").first()["c"]
    signal, total = int(head[0]), int(head[0]) + int(head[1])
    found = rows.count() - 1
    if found != total:
        raise ValueError(f"{found} rows, but the first line says {total}")
    return rows.where("row_id > 0").select((F.col("row_id") - 1).alias("row_id"), F.col("c").cast("array<double>").alias("features"), (F.col("row_id") <= signal).cast("int").alias("label"))


def read_position_split(points: DataFrame, test_rows: int) -> DataFrame:
    """Adds ``split``: the last ``test_rows`` rows by position are the test rows."""
    return points.withColumn("split", F.when(F.col("row_id") >= points.count() - test_rows, "test").otherwise("train"))


def read_clean_dirty(spark: SparkSession, clean: str, dirty: str, target: str) -> DataFrame:
    """Clean and dirty CSVs with headers, paired by position: one row of both, dirty columns in the clean order.

    Rows stay if the clean label isn't blank; row_id is the original position.
    """
    c = spark.read.csv(clean, header=True, inferSchema=False)
    d = spark.read.csv(dirty, header=True, inferSchema=False).select(*c.columns)
    a = numbered(c).select("row_id", F.struct(*c.columns).alias("clean"))
    b = numbered(d).select("row_id", F.struct(*c.columns).alias("dirty"))
    return a.join(b, "row_id").where(f"nullif(trim(clean.`{target}`), '') IS NOT NULL")


def read_zip_member(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Lines (value) of one member of zip archives, gunzipped if it is a .gz."""
    import gzip

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    data = z.read(member)
                yield pd.DataFrame({"value": (gzip.decompress(data) if member.endswith(".gz") else data).decode().splitlines()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """points from .npz files with X (n x d) and y (n): both are required, of equal length."""
    import numpy as np

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf["content"]:
                z = np.load(io.BytesIO(content))
                x, y = np.asarray(z["X"], np.float32), np.asarray(z["y"], np.int64)
                if x.ndim != 2 or y.ndim != 1 or len(x) != len(y):
                    raise ValueError("X must be n x d and y of length n")
                ids = z["row_id"] if "row_id" in z.files else np.arange(len(y))
                yield pd.DataFrame({"row_id": ids, "features": x.astype(float).tolist(), "label": y.astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_id bigint, features array<double>, label int")


def check_header(columns: list[str]) -> None:
    """Columns are feature_0, feature_1, ... and label last."""
    if not columns or columns[-1] != "label" or columns[:-1] != [f"feature_{i}" for i in range(len(columns) - 1)]:
        raise ValueError("columns must be feature_0.. in order, label last")


def checked(points: DataFrame) -> DataFrame:
    """The points, if none has a missing feature or label."""
    if not points.where(F.exists("features", lambda x: x.isNull() | F.isnan(x)) | F.col("label").isNull()).isEmpty():
        raise ValueError("missing values")
    return points


def write_points(points: DataFrame, path: str, overwrite: bool = False) -> None:
    points.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_csv(points: DataFrame, path: str, d: int, overwrite: bool = False) -> None:
    """feature_0.., label last, with a header."""
    points.select(*[F.col("features")[i].alias(f"feature_{i}") for i in range(d)], "label").write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def write_noisy(noisy: DataFrame, root: str, dataset: str, kind: str, rate: float, split: str = "train", overwrite: bool = False) -> None:
    """The noisy-dataset layout: partitions by noise type, rate, dataset and split."""
    path = f"{root}/noise_type={kind}/noise_rate={rate:.2f}/dataset={dataset}/split={split}"
    noisy.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_noisy(spark: SparkSession, root: str, dataset: str, kind: str, rate: float, split: str = "train") -> DataFrame:
    df = spark.read.parquet(root)
    keep = (F.col("noise_type") == kind) & (F.col("noise_rate").cast("double") == rate) & (F.col("dataset") == dataset) & (F.col("split") == split)
    return df.where(keep).drop("noise_type", "noise_rate", "dataset", "split")


def deep_update(base: dict, *layers: dict) -> dict:
    """A new dict: later layers win, nested dicts are merged; nothing is shared with the inputs."""
    out = json.loads(json.dumps(base))
    for layer in layers:
        for k, v in layer.items():
            out[k] = deep_update(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else json.loads(json.dumps(v))
    return out
