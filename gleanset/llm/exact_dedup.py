"""Exact deduplication against a persistent digest index.

The index is a bucketed, sorted table of unique digests. A new batch is reduced to one row per digest
(partial aggregates before the shuffle, so a text that a third of the rows repeat costs one row per
task), sort-merge anti-joined with the index (whose side isn't shuffled: it is bucketed by digest) and
appended. Row-level results come from a join of two shuffled sides, of which Spark's adaptive
execution splits a hot digest.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, exists, load, names, quoted, remove, shared_dir, text_of, touch, unused

#: Buckets of a new index: one for each so many bytes of digests that it is to hold, at these limits.
BUCKET_BYTES = 256 << 20
LEAST_BUCKETS, MOST_BUCKETS = 32, 1 << 16
ROW_BYTES = 80


def buckets_for(rows: int) -> int:
    """Buckets of an index that is to hold so many digests."""
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, rows * ROW_BYTES / BUCKET_BYTES))))))


class DigestIndex:
    """A persistent table (digest, keep_id, batch), partitioned by batch, bucketed and sorted by digest, at ``path``.

    Another session opens the same index by the same path and finds its number of buckets there; ``buckets`` is that of a
    new one. A batch is written under its number: writing it again replaces it. There is one writer at a time.

    The table lies in a folder of its own below ``path``, a generation. An empty file ``ready-<generation>-<buckets>`` beside it
    publishes it; the newest published generation is the index. A rebuild writes the next generation whole and
    publishes it by that one file, so a rebuild that is lost half-way leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = LEAST_BUCKETS):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/gleanset/digests-{uuid.uuid4().hex[:12]}"
        self.generation, self.buckets, self.table = 0, buckets, ""
        if not self._published():
            self._publish(1, buckets)
        self._follow()

    def _published(self) -> list[tuple[int, int]]:
        """(generation, buckets) of what is published, the newest last."""
        found = [re.fullmatch(r"ready-(\d+)-(\d+)", name) for name in names(self.spark, self.path)]
        return sorted((int(m[1]), int(m[2])) for m in found if m)

    def _publish(self, generation: int, buckets: int) -> None:
        touch(self.spark, f"{self.path}/ready-{generation:06d}-{buckets}")

    def _place(self, generation: int) -> str:
        return f"{self.path}/generation-{generation:06d}"

    def _named(self, generation: int, buckets: int) -> str:
        """A table over the files of a generation."""
        place = self._place(generation)
        table = f"gleanset_digests_{hashlib.sha256(place.encode()).hexdigest()[:16]}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # external: the files stay
        self.spark.sql(
            f"CREATE TABLE {table} (digest STRING, keep_id BIGINT, batch BIGINT) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        if exists(self.spark, place):
            self.spark.sql(f"MSCK REPAIR TABLE {table}")  # finds the batches of earlier sessions
        return table

    def _follow(self) -> None:
        """Use the newest generation, whoever published it."""
        generation, buckets = self._published()[-1]
        if generation != self.generation:
            self.generation, self.buckets = generation, buckets
            self.table = self._named(generation, buckets)

    def rows(self) -> DataFrame:
        self._follow()
        return self.spark.table(self.table)

    def before(self, batch: int | None) -> DataFrame:
        """The digests of other batches (of all without ``batch``); what an earlier try of this batch has left doesn't count."""
        return self.rows() if batch is None else self.rows().where(F.col("batch") != batch)

    def unseen(self, groups: DataFrame, batch: int | None = None) -> DataFrame:
        """The groups whose digest is in no other batch: a sort-merge anti-join."""
        return groups.hint("merge").join(self.before(batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: int = 0) -> None:
        """Write a batch; a batch of that number is replaced."""
        self._follow()
        self._write(groups.select("digest", "keep_id", F.lit(batch).cast("long").alias("batch")), self.table, self.buckets)

    def _write(self, rows: DataFrame, table: str, buckets: int) -> None:
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            rows.repartition(buckets, "digest").write.insertInto(table, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)
        self.spark.catalog.refreshTable(table)

    def rebuild(self, buckets: int | None = None) -> None:
        """Write all batches anew, each under its number in one sorted file a bucket, and with another number of buckets if given.

        The index stays at its path. Queries that still read the old files fail and can be made anew.
        """
        rows, buckets = self.rows(), buckets or self.buckets
        new = self.generation + 1
        remove(self.spark, self._place(new))  # of a rebuild that was lost half-way
        self._write(rows, self._named(new, buckets), buckets)
        self._publish(new, buckets)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._follow()
        for generation, count in self._published()[:-1]:
            remove(self.spark, f"{self.path}/ready-{generation:06d}-{count}")
        for name in names(self.spark, self.path):
            if name.startswith("generation-") and name != self._place(new).rpartition("/")[2]:
                remove(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the whole text in UTF-8; null counts as empty."""
    return text_of(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))


def summarised(found: DataFrame, index: DigestIndex, batch: int) -> DataFrame:
    """(digest, keep_id, group_size, seen_before) of every digest of the batch; new digests go to the index as this batch.

    The table is written before the index: a try that fails in between leaves an index without this batch, and a try that
    fails later leaves one that the next try replaces.
    """
    work = Scratch(found.sparkSession, "exact")
    groups = work.keep(found.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    fresh = work.keep(index.unseen(groups, batch), "fresh")
    old = groups.join(fresh.select("digest"), "digest", "left_anti").select("digest", "group_size").join(index.before(batch).groupBy("digest").agg(F.max("keep_id").alias("keep_id")), "digest")
    summary = work.keep(fresh.select("digest", "keep_id", "group_size", F.lit(False).alias("seen_before")).unionByName(old.withColumn("seen_before", F.lit(True))), "summary")
    index.append(fresh, batch)
    work.drop("groups", "fresh")
    return summary


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, seen_before.

    Equal texts are those of one digest. Of texts new to the index the row with the largest doc_id
    stays; texts already in the index by another batch are dropped and point to the row kept then. group_size counts
    the rows of this batch. New digests are appended to the index; a batch that is run again gives the same rows again.

    Defined cases: null text is the empty text; very long texts are digested whole; a null doc_id never wins over another
    id, and in a group without ids every row is kept with keep_id null; rows that repeat the keeper's doc_id with
    the same text are all kept (they are one document); other columns aren't looked at; an empty table gives no rows.
    """
    found = digests(docs, id_col, text_col)
    summary = summarised(found, index, batch)
    return found.join(summary.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("seen_before")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "seen_before",
    )


def deduplicated(docs: DataFrame, index: DigestIndex, batch: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each text that is new to the index: the one of the largest
    doc_id, and of rows that repeat id and text one. A null text is the empty text. Rows are told apart by id and text, never by the id alone."""
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    key, keep = unused(docs, "digest", "keep")
    summary = summarised(digests(docs, id_col, text_col), index, batch).where("NOT seen_before").select(F.col("digest").alias(key), F.col("keep_id").alias(keep))
    rows = docs.withColumn(key, digest).join(summary.hint("merge"), key)
    rows = rows.where(F.col(quoted(id_col)).cast("long").eqNullSafe(F.col(keep)))
    return rows.dropDuplicates([key]).select(*map(quoted, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    index = DigestIndex(spark, buckets=buckets_for(docs.count()))
    out = exact_dedup(docs, index).drop("seen_before")
    index.drop()
    return out


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
