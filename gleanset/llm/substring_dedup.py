"""Substring deduplication by sliding sentence spans.

Runs are ``SENTENCES`` consecutive sentences and ``LEAST_WORDS`` words at least. The query hashes, of
each sentence, the shortest run that starts with it and the shortest that ends with it: a longer run that repeats
is covered by such runs inside it, which repeat with it. Runs are counted globally; of a run that occurs more than once the first place (by doc_id,
then sentence) stays, and sentences that any other place covers are removed.

Run hashes are aggregated with partial aggregates, so a passage that a third of the documents share is one
row per task. A second pass emits only the places of repeated runs (a Bloom filter of fixed size
names them to the workers, a join of two shuffled sides, which Spark can split, makes it exact).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import KeyFilter, Scratch, load, text_of
from ._text import NON_SPACE, U, Words, batches, mix, powers, utf8

SENTENCES = 2
LEAST_WORDS = 15
_STOPS = (ord("."), ord("!"), ord("?"))


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence (and the end), and the document of each.

    A sentence ends with a word whose last byte is a full stop, exclamation or question mark, before a line
    break, and with the document.
    """
    n = len(w.starts)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(w.data == 10)])
    begins = np.zeros(n, bool)
    begins[w.first[:-1][w.counts > 0]] = True
    begins[1:] |= np.isin(w.data[w.ends[:-1] - 1], _STOPS) | (lines[w.starts[1:]] > lines[w.ends[:-1]])
    first = np.flatnonzero(begins)
    return np.append(first, n), w.doc[first]


def spans(w: Words, least_sentences: int, least_words: int, both_ends: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first sentence in the document, end sentence) of the shortest run from each sentence on; with
    ``both_ends`` also of the shortest up to each sentence, if it isn't one of those."""
    begin, doc = sentences(w)
    none = np.zeros(0, np.int64)
    if not len(doc):
        return none.astype(U), none, none, none
    i = np.arange(len(doc))
    head = np.searchsorted(doc, np.arange(len(w.first) - 1))
    last = np.searchsorted(doc, doc, "right")
    end = np.maximum(i + least_sentences, np.searchsorted(begin, begin[:-1] + least_words))
    ok = end <= last
    a, z = i[ok], end[ok]
    if both_ends:
        start = np.minimum(i + 1 - least_sentences, np.searchsorted(begin, begin[1:] - least_words, "right") - 1)
        more = start >= head[doc]
        more[more] = end[start[more]] != i[more] + 1
        a, z = np.concatenate([a, start[more]]), np.concatenate([z, i[more] + 1])
    i, end = a, z
    up, down = powers(len(w.hash) + 1)
    c = np.concatenate([[U(0)], np.cumsum(w.hash * up[:-1], dtype=U)])
    a, b = begin[i], begin[end]
    return mix((c[b] - c[a]) * down[a] + (b - a).astype(U)), doc[i], i - head[doc[i]], end - head[doc[i]]


def _emit(least_sentences: int, least_words: int, both_ends: bool, wanted: KeyFilter | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            h, doc, first, end = spans(Words(*utf8(b.column("text")), NON_SPACE), least_sentences, least_words, both_ends)
            if wanted is not None:
                keep = wanted.test(h)
                h, doc, first, end = h[keep], doc[keep], first[keep], end[keep]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("doc_id").take(rows), b.column("version").take(rows), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], ["h", "doc_id", "version", "first", "end"])

    return run


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(parts):
        column = b.column("text")
        w = Words(*utf8(column), NON_SPACE)
        begin, doc = sentences(w)
        head = np.searchsorted(doc, np.arange(len(w.first)))
        raw = column.to_pylist()
        count, removed, chars, out = np.diff(head), [], [], []
        for d, (text, places) in enumerate(zip(raw, b.column("places").to_pylist(), strict=True)):
            n = int(count[d])
            gone = np.zeros(n + 1, np.int32)
            for p in places or ():
                gone[p["first"]] += 1
                gone[min(p["end"], n)] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            if not gone.any():
                removed.append(0)
                chars.append(0)
                out.append(text)
                continue
            data = text.encode()
            edge = [*(w.starts[begin[head[d] : head[d + 1]]] - w.offsets[d]).tolist(), len(data)]
            kept = [data[: edge[0]], *(data[edge[k] : edge[k + 1]] for k in range(n) if not gone[k])]
            new = b"".join(kept).decode()
            removed.append(int(gone.sum()))
            chars.append(len(text) - len(new))
            out.append(new)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(chars, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_sentences", "n_removed", "chars_removed", "text"])


def substring_dedup(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", both_ends: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences, n_removed, chars_removed, text (what is left).

    Without ``both_ends`` only runs from each sentence on count: short sentences at a repeated passage's end can stay.
    Defined cases: null texts stay null and empty ones empty, with no sentences; rows with a null doc_id
    are returned as they are and take no part; rows that repeat a doc_id and text are one document;
    a passage repeated inside one document stays at its first place; words are compared without
    regard to ASCII case and white space; an empty table gives no rows.
    """
    work = Scratch(docs.sparkSession, "spans")
    # A document is its id and its text, should an id come with several texts.
    df = text_of(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    named = df.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "version", "text")
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"h long, doc_id {kind}, version long, first int, end int"
    runs = named.mapInArrow(_emit(least_sentences, least_words, both_ends, None), schema)
    firsts = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "version", "first")).alias("f"))
    repeated = work.keep(firsts.where("n > 1").select("h", F.col("f.doc_id").alias("d"), F.col("f.version").alias("v"), F.col("f.first").alias("s")), "repeated")
    places = named.mapInArrow(_emit(least_sentences, least_words, both_ends, KeyFilter(repeated, "h")), schema)
    later = places.join(repeated.hint("merge"), "h").where("NOT (doc_id = d AND version = v AND first = s)")
    gone = work.keep(later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "end")).alias("places")), "gone")
    joined = df.join(gone, ["doc_id", "version"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_cut, f"doc_id {kind}, n_sentences long, n_removed long, chars_removed long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents"), both_ends=True)
