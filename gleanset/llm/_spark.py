"""Session helpers: the shared folder, tables that cut lineage, bounded sets of key hashes."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="gleanset-")
        shared_dir.own = found
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage: executors may be lost, the tables stay.

    ``keep`` writes a frame and reads it again; ``drop`` removes tables that are no longer read.
    """

    #: While a table is written: its shuffle files go when it is done, which they are of no more use for, and Python
    #: workers get batches of a few MB of texts at once.
    CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/gleanset/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        conf = self.spark.conf
        before = {k: conf.get(k) for k in self.CONF}
        for k, v in self.CONF.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            remove(self.spark, f"{self.at}/{name}".rstrip("/"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder of any file system holds; nothing if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file, and the folders above it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until the frame has no such column (in either case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column name as it is, also with dots or backticks in it."""
    return f"`{name.replace('`', '``')}`"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class KeyFilter:
    """A Bloom filter (2 hashes) over a column of ``count`` bigint hashes, some 16 bits a key.

    It is built by ``bitmap_construct_agg`` on the executors; the driver receives 2**MOST_BITS / 8 bytes at most
    (32 MB) whatever the input, so that it can be broadcast. It has false positives, more of them beyond
    some 2**24 keys, and no false negatives: callers join exactly afterwards.
    """

    MOST_BITS = 28

    def __init__(self, df: DataFrame, key: str, count: int | None = None):
        import numpy as np

        count = df.count() if count is None else count
        log2_bits = min(self.MOST_BITS, max(16, math.ceil(math.log2(16 * count + 1))))
        self.bits = log2_bits
        n = 1 << log2_bits
        low = F.col(key).bitwiseAND(n - 1)
        high = F.shiftright(key, 64 - log2_bits).bitwiseAND(n - 1)
        bit = df.select(F.explode(F.array(low, high)).alias("b"))
        # Positions are 1-based in Spark's bitmap functions.
        rows = (
            bit.select((F.col("b") + 1).alias("b"))
            .groupBy(F.expr("bitmap_bucket_number(b)").alias("k"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("m"))
        )
        out = np.zeros(n // 8, dtype=np.uint8)
        for r in rows.toLocalIterator():
            part = np.frombuffer(bytes(r.m), dtype=np.uint8)
            at = (r.k - 1) * 4096
            out[at : at + 4096] = part[: max(0, len(out) - at)]
        self.data = out.tobytes()

    def test(self, h):
        """Which of the int64/uint64 hashes may be members."""
        import numpy as np

        m = np.frombuffer(self.data, dtype=np.uint8)
        h = h.view(np.uint64)
        low = (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        high = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return ((m[low >> 3] >> (low & 7).astype(np.uint8)) & (m[high >> 3] >> (high & 7).astype(np.uint8)) & 1).astype(bool)


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that are used, under fixed names: extra columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def salted(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))
