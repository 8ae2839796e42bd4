"""Tables without their lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """The table without its lineage, in the folder of spark.checkpoint.dir; where that is unset, a folder of our own
    in local mode, and an error on a cluster."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="gleanset-"))
    return df.checkpoint()


def gathered(df: DataFrame) -> DataFrame:
    """The table in at most four partitions a core, without a shuffle, for passes that are made again and again."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
