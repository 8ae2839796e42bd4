"""Corpus pipeline: language identification, exact and near deduplication, decontamination, tokens.

Each stage works on all that its predecessor kept; the stages but the last return the columns of documents.
Stages decide by rows (id and text), never by the id alone: rows without id or with repeated ids are documents of
their own. Null, empty and wordless texts go in the first stage; very long texts are worked on whole; repeated rows
leave one; an empty table gives no rows; columns of any other name pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from gleanset.llm._spark import Scratch, load, quoted, unused

#: Near duplicates of the pipeline; op3's contract (4 words, 85 %) binds that query only.
SHINGLE, PERCENT = 5, 80


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of some learned language: those without letters, or like no language at all, go."""
    langs, profiles = language_id.learn(docs)
    lang, cosine = unused(docs, "found_lang", "cosine")
    found = language_id.identify(docs, langs, profiles, out=(lang, cosine))
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(cosine) > 0)).select(*map(quoted, docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat id and text, one."""
    index = exact_dedup.DigestIndex(spark, buckets=exact_dedup.buckets_for(docs.count()))
    out = exact_dedup.deduplicated(docs, index)
    index.drop()
    return out


def unalike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word similarity from 0.8 on) stays: that of the smallest doc_id."""
    return jaccard_join.one_of_each(docs, SHINGLE, PERCENT)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the token ids' digest, and that of what they decode to."""
    return bpe.bpe_digest(docs, *bpe.vocabulary())


STAGES = [("language", identified), ("exact", distinct), ("near", unalike), ("benchmark", clean), ("tokens", tokens)]

#: SQL can't express language identification.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = load(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
