"""Benchmark decontamination by suffix arrays of the training texts.

Each batch of documents is a shard. A shard's words become ids of the benchmark's vocabulary (0: a word
foreign to it, where every match ends), and the suffixes are sorted by prefix doubling. Suffixes that
meet a foreign word before the shortest window is full can't hold a window and are left out. Every
suffix of every benchmark item is then binary-searched, word by word, for all places of its window and
its longest verbatim match. Texts are never shuffled; nothing of the documents reaches the driver.

The benchmark is sent to the workers in blocks of ``BLOCK_BYTES`` at most, whatever its size; each
block is one pass of the same stage, and passes hand on the covered words of each document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import load, text_of
from ._text import WORDS, Words, batches, utf8

WINDOW = 10
#: A block holds so many bytes of benchmark text, or one item.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20


@dataclass
class Block:
    """A block of benchmark items: its vocabulary, its suffixes and their windows."""

    labels: list[str | None]
    words: list[list[bytes]]
    vocabulary: np.ndarray  # sorted hashes; the id of a word is its place + 1
    ids: np.ndarray  # word ids of all items, each followed by a 0
    item: np.ndarray  # by suffix: the item
    start: np.ndarray  # by suffix: its place in ids
    offset: np.ndarray  # by suffix: its word in the item
    size: int  # words of a window
    length: np.ndarray  # by item: words of its windows


def block_of(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Block:
    texts = [t or "" for _, t in rows]
    w = Words(*utf8(pa.array(texts, pa.large_string())), WORDS)
    raw = w.data.tobytes()
    words = [[raw[a:b] for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    vocabulary = np.unique(w.hash)
    n = w.counts
    at = np.arange(len(w.hash)) + w.doc
    ids = np.zeros(len(w.hash) + len(n) + 1, np.int32)
    ids[at] = np.searchsorted(vocabulary, w.hash) + 1
    length = np.minimum(n, window)
    offset = np.arange(len(w.hash)) - w.first[w.doc]
    full = offset + length[w.doc] <= n[w.doc]
    return Block([None if i is None else str(i) for i, _ in rows], words, vocabulary, ids, w.doc[full], at[full], offset[full], window, length)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the non-zero ids, sorted by what follows up to ``depth`` ids or the next 0 (prefix doubling)."""
    rank, k = ids.astype(np.int64), 1
    at = np.flatnonzero(ids)
    while k < depth:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-k] = rank[k:]
        # A suffix that has met a 0 has ended: it takes no more from what lies behind.
        key = rank * (int(rank.max(initial=0)) + 1) + nxt
        key[ids == 0] = 0
        values, dense = np.unique(key, return_inverse=True)
        ended = len(values) - (values[:1] != 0).sum() if len(values) else 0
        rank = dense.astype(np.int64) + (0 if len(values) and values[0] == 0 else 1)
        k *= 2
        if ended >= len(at) + 1:
            break
    return at[np.argsort(rank[at], kind="stable")]


def descend(sa: np.ndarray, ids: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By test suffix: the range of the suffix array whose suffixes start with its window, and whether there is one."""
    q = np.arange(len(block.start))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
    need = block.length[block.item]
    for d in range(int(need.max(initial=0))):
        on = q[(need[q] > d)]
        if not len(on):
            break
        want = block.ids[block.start[on] + d].astype(np.int64)
        column = ids[np.minimum(sa + d, len(ids) - 1)].astype(np.int64)
        ends = []
        for side in (0, 1):
            a, b = lo[on].copy(), hi[on].copy()
            while (open_ := a < b).any():
                m = (a + b) >> 1
                less = np.zeros(len(on), bool)
                got = column[np.minimum(m, len(sa) - 1)]
                less = open_ & ((got < want) if side == 0 else (got <= want))
                a = np.where(less, m + 1, a)
                b = np.where(open_ & ~less, m, b)
            ends.append(a)
        lo[on], hi[on] = ends
        q = np.concatenate([q[need[q] <= d], on[ends[0] < ends[1]]])
    return lo, hi, np.isin(np.arange(len(lo)), q)


def occurrences(w: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, word of the batch where its window starts) for every occurrence in the shard."""
    none = np.zeros(0, np.int64)
    if not len(w.hash) or not len(block.start):
        return none, none
    place = np.minimum(np.searchsorted(block.vocabulary, w.hash), len(block.vocabulary) - 1)
    known = block.vocabulary[place] == w.hash
    # Runs of known words inside a document, from their first word to the next foreign word or document.
    n = len(known)
    head = np.arange(n) == w.first[w.doc]
    begins = np.flatnonzero(known & (np.concatenate([[True], ~known[:-1]]) | head))
    limits = np.union1d(np.flatnonzero(~known), np.append(w.first[:-1], n))
    run = limits[np.searchsorted(limits, begins, "right")] - begins
    long = run >= int(block.length[block.length > 0].min())
    first, run = begins[long], run[long]
    if not len(first):
        return none, none
    sizes = run + 1
    shift = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    back = np.arange(int(sizes.sum())) + shift
    end = np.cumsum(sizes) - 1
    ids = np.where(np.isin(np.arange(len(back)), end), 0, place[np.minimum(back, n - 1)] + 1).astype(np.int32)
    sa = suffix_array(ids, int(block.length.max()))
    lo, hi, hit = descend(sa, ids, block)
    which = np.flatnonzero(hit)
    many = hi[which] - lo[which]
    suffix = np.repeat(which, many)
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return suffix, back[sa[np.repeat(lo[which], many) + inner]]


def matches(w: Words, block: Block) -> np.ndarray:
    """Maximal verbatim matches: rows (batch word, words, item, item word), checked against the words' bytes."""
    suffix, at = occurrences(w, block)
    if not len(at):
        return np.zeros((0, 4), np.int64)
    item, off = block.item[suffix], block.offset[suffix]
    order = np.lexsort((at, at - off, item))
    item, off, at = item[order], off[order], at[order]
    doc = w.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - off[1:] != at[:-1] - off[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    size = count + block.length[item[begin]] - 1
    rows = np.stack([at[begin], size, item[begin], off[begin]], 1)
    raw = w.data.tobytes()
    # Hashes found them; the bytes decide.
    same = [all(raw[w.starts[a + j] : w.ends[a + j]] == block.words[i][o + j] for j in range(s)) for a, s, i, o in rows.tolist()]
    return rows[np.array(same, bool)]


STATE = "cover binary, items array<string>, longest_words long, longest_item string, longest_at long"
EMPTY_STATE = ["cast('' AS binary) AS cover", "cast(array() AS array<string>) AS items", "0L AS longest_words", "cast(NULL AS string) AS longest_item", "cast(NULL AS bigint) AS longest_at"]


def merged(intervals: np.ndarray) -> np.ndarray:
    """Sorted disjoint intervals [a, b) that cover the same words."""
    if len(intervals) < 2:
        return intervals
    x = intervals[np.argsort(intervals[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    new = np.ones(len(x), bool)
    new[1:] = x[1:, 0] > reach[:-1]
    begin = np.flatnonzero(new)
    return np.stack([x[begin, 0], reach[np.append(begin[1:], len(x)) - 1]], 1)


def _scan(block: Block, last: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts, limit=SHARD_BYTES):
            w = Words(*utf8(b.column("text")), WORDS)
            rows = matches(w, block)
            state = [b.column(c).to_pylist() for c in ("cover", "items", "longest_words", "longest_item", "longest_at")]
            doc = w.doc[rows[:, 0]] if len(rows) else np.zeros(0, np.int64)
            for d in np.unique(doc).tolist():
                mine = rows[doc == d]
                here = np.stack([mine[:, 0], mine[:, 0] + mine[:, 1]], 1) - w.first[d]
                old = np.frombuffer(state[0][d], np.int64).reshape(-1, 2)
                state[0][d] = merged(np.concatenate([old, here])).tobytes()
                state[1][d] = sorted({*state[1][d], *(block.labels[i] for i in mine[:, 2].tolist() if block.labels[i] is not None)})
                best = mine[np.lexsort((mine[:, 0], -mine[:, 1]))[0]].tolist()
                if best[1] > state[2][d]:
                    state[2][d], state[3][d], state[4][d] = best[1], block.labels[best[2]], best[0] - int(w.first[d])
            kinds = [pa.binary(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]
            columns = {"doc_id": b.column("doc_id")}
            if last:
                cover = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in state[0]]
                hit = [int((x[:, 1] - x[:, 0]).sum()) for x in cover]
                columns |= {
                    "n_words": pa.array(w.counts, pa.int64()),
                    "n_hit": pa.array(hit, pa.int64()),
                    "n_items": pa.array([len(x) for x in state[1]], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in state[1]], pa.string()),
                    "contaminated": pa.array([h > 0 for h in hit], pa.bool_()),
                } | dict(zip(("longest_words", "longest_item", "longest_at"), [pa.array(s, k) for s, k in zip(state[2:], kinds[2:], strict=True)], strict=True))
            else:
                columns |= {"text": b.column("text")} | dict(zip(("cover", "items", "longest_words", "longest_item", "longest_at"), [pa.array(s, k) for s, k in zip(state, kinds, strict=True)], strict=True))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> list[Block]:
    """The benchmark in blocks of checked size; a block alone is held by the driver while it is built."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    total = b.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    part = lambda k: b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return [block_of([(r.item_id, r.text) for r in part(k).toLocalIterator()], window) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the
    longest verbatim match: longest_words, longest_item, longest_at (its first word in the document).

    Defined cases: null or empty texts have no words and no hits; a very long text is a shard of its own; of equally long
    matches the first by place is the longest; other columns aren't looked at; items without words have no window;
    items of fewer words than ``window`` are one window; words of an item with a null item_id count as
    hit, the item isn't listed; repeated item_ids count once; an empty benchmark hits nothing.
    """
    found = blocks(benchmark, item_col, item_text_col, block_bytes, window)
    df = text_of(docs, id_col, text_col).selectExpr("doc_id", "text", *EMPTY_STATE)
    kind = df.schema["doc_id"].dataType.simpleString()
    for k, block in enumerate(found):
        last = k == len(found) - 1
        out = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_item string, longest_at long"
        df = df.mapInArrow(_scan(block, last), f"doc_id {kind}, " + (out if last else f"text string, {STATE}"))
    return df


def _without(block: Block, text_col: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts, text_col, SHARD_BYTES):
            w = Words(*utf8(b.column(text_col)), WORDS)
            rows = matches(w, block)
            clean = np.ones(b.num_rows, bool)
            clean[w.doc[rows[:, 0]]] = False
            yield b.filter(pa.array(clean))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns kept, in one pass without a shuffle. Rows go by their own
    text, whatever their ids: a contaminated row without id goes too, and a clean row that shares its id with one stays."""
    for block in blocks(benchmark, item_col, item_text_col, block_bytes, window):
        docs = docs.mapInArrow(_without(block, text_col), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       coalesce(t.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
