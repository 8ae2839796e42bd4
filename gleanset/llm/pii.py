"""Personal data by patterns, and information-theoretic sanitisation of the terms that give it away.

Base spans (email, ip, card, phone) are the protected entities. A term (a word outside the spans)
reveals an entity as far as the corpus says so: of the documents that have the term, in what share does
it stand near the entity, and how many bits does that add over the entity's own share of all
documents? Terms over both thresholds, seen near the entity in several different contexts, are
disclosing: every place of theirs is a span as well, and sanitising generalises entities to their kind
and removes disclosing terms.

Three passes over the texts: contexts of entities; document counts (over all documents) of the terms
that may qualify, which a Bloom filter of fixed size names to the workers and a join makes exact; and
the marking, which carries the disclosing terms to the workers in blocks of ``TERM_BLOCK``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import KeyFilter, Scratch, load, text_of
from ._text import WORDS, Words, batches, utf8

KINDS = ("email", "ip", "card", "phone")
# The base patterns. The looks around digits change no match (a match never starts or ends
# inside a run of digits) and keep long runs of digits linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words on each side of an entity that count as its context.
CONTEXT = 8
#: A disclosing term has been seen in so many different contexts of the entity,
MIN_CONTEXTS = 3
#: in so large a share of the documents that have the term,
MIN_SHARE = 0.5
#: and adds so many bits to what is known of the entity.
MIN_BITS = 3.0
TERM_LEAST = 3
TERM_BLOCK = 1_000_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(from, kind, to) in code points, sorted; matches of a kind don't overlap, failing ones are dropped."""
    out, at = [], text.find("@")
    reach = 0
    while at >= 0:
        a = at
        while a > reach and text[a - 1] in LOCAL_CHARS:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            reach = m.end()
        at = text.find("@", max(at + 1, reach))
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    return sorted(out)


def _entity(text: str, span: tuple[int, int, int]) -> int:
    """A hash of kind and value: e-mails in lower case, numbers by their digits."""
    a, k, b = span
    value = text[a:b].lower() if k == 0 else text[a:b] if k == 1 else re.sub("[^0-9]", "", text[a:b])
    return int.from_bytes(hashlib.blake2b(f"{KINDS[k]}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _terms(w: Words) -> np.ndarray:
    """Which words may be terms: long enough and not digits alone."""
    size = w.ends - w.starts
    digit = np.concatenate([[0], np.cumsum((w.data >= 48) & (w.data <= 57))])
    return (size >= TERM_LEAST) & (digit[w.ends] - digit[w.starts] < size)


def _byte_spans(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    if text.isascii():
        return [(a, b) for a, _, b in spans]
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return [(int(at[a]), int(at[b])) for a, _, b in spans]


def _contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, context, documents) of every document, once each; term 0 says that the document has the entity.

    The first context of each entity and term in a document counts 1 document, the others 0.
    """
    for b in batches(parts):
        rows = []
        for text in b.column("text").to_pylist():
            spans = base_spans(text or "")
            if not spans:
                continue
            w = Words(*utf8(pa.array([text], pa.large_string())), WORDS)
            ok, mine, counted = _terms(w), set(), set()
            x = np.array(_byte_spans(text, spans), np.int64)
            # Words before and after each span; those between touch it.
            before, after = np.searchsorted(w.ends, x[:, 0], "right").tolist(), np.searchsorted(w.starts, x[:, 1]).tolist()
            for i, j in zip(before, after, strict=True):
                ok[i:j] = False
            h = w.hash.view(np.int64)
            for span, i, j in zip(spans, before, after, strict=True):
                e = _entity(text, span)
                mine.add((e, 0, 0))
                near = np.concatenate([np.arange(max(0, i - CONTEXT), i), np.arange(j, min(len(h), j + CONTEXT))])
                near = near[ok[near]]
                if len(near):
                    c = int(np.bitwise_xor.reduce(h[near] * np.arange(1, 2 * len(near), 2, dtype=np.int64)))
                    mine.update((e, t, c) for t in h[near].tolist())
            for e, t, c in mine:
                rows.append((e, t, c, int((e, t) not in counted)))
                counted.add((e, t))
        if rows:
            x = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(4)], ["entity", "term", "context", "documents"])


def _frequencies(wanted: KeyFilter):
    """(term, documents) of the terms that may be wanted, by batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            w = Words(*utf8(b.column("text")), WORDS)
            keep = wanted.test(w.hash) & _terms(w)
            pairs = np.unique(np.stack([w.hash[keep].view(np.int64), w.doc[keep]], 1), axis=0)[:, 0]
            terms, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], ["term", "documents"])

    return run


def disclosing_terms(texts: DataFrame, work: Scratch) -> DataFrame:
    """(term): hashes of the terms that reveal some entity beyond the thresholds; ``texts`` has the column text."""
    seen = texts.mapInArrow(_contexts, "entity long, term long, context long, documents long").groupBy("entity", "term", "context").agg(F.sum("documents").alias("n"))
    pairs = work.keep(seen.groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("contexts")), "pairs")
    likely = work.keep(pairs.where(f"term <> 0 AND contexts >= {MIN_CONTEXTS}"), "likely")
    wanted = KeyFilter(likely.select("term").distinct(), "term")
    documents = texts.mapInArrow(_frequencies(wanted), "term long, documents long").groupBy("term").agg(F.sum("documents").alias("documents"))
    entities = pairs.where("term = 0").select("entity", F.col("together").alias("with_entity"))
    everything = texts.select(F.count(F.lit(1)).alias("n")).first()["n"]
    share = F.col("together") / F.col("documents")
    bits = F.log2(share / (F.col("with_entity") / F.lit(max(1, everything))))
    return likely.join(documents, "term").join(entities, "entity").where((share >= MIN_SHARE) & (bits >= MIN_BITS)).select("term").distinct()


def _mark(terms: np.ndarray, first: bool):
    """Adds to ``spans`` the base spans (in the first pass) and the places of a block of disclosing terms."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            texts = b.column("text").to_pylist()
            found = [base_spans(t or "") for t in texts] if first else [[tuple(s.values()) for s in x] for x in b.column("spans").to_pylist()]
            if len(terms):
                w = Words(*utf8(b.column("text")), WORDS)
                place = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
                hit = np.flatnonzero((terms[place] == w.hash) & _terms(w))
                docs, begins = np.unique(w.doc[hit], return_index=True)
                for d, mine in zip(docs.tolist(), np.split(hit, begins)[1:], strict=True):
                    lo, hi = w.starts[mine] - w.offsets[d], w.ends[mine] - w.offsets[d]
                    if not texts[d].isascii():
                        points = np.concatenate([[0], np.cumsum((w.data[w.offsets[d] : w.offsets[d + 1]] & 0xC0) != 0x80)])
                        lo, hi = points[lo], points[hi]
                    base = np.array(sorted((a, z) for a, k, z in found[d] if k < 4), np.int64).reshape(-1, 2)
                    # A base span overlaps if, of those that begin before the term's end, the last to end does so after its start.
                    reach = np.concatenate([[0], np.maximum.accumulate(base[:, 1])])
                    free = reach[np.searchsorted(base[:, 0], hi)] <= lo
                    found[d] += [(x, 4, y) for x, y in zip(lo[free].tolist(), hi[free].tolist(), strict=True)]
            rows = [[{"from": a, "kind": k, "to": z} for a, k, z in sorted(x)] for x in found]
            kind = pa.list_(pa.struct([("from", pa.int32()), ("kind", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(rows, kind)], ["doc_id", "text", "spans"])

    return run


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): all spans (from, kind, to) of every row, kinds 0 to 3 as listed and 4 for disclosing terms.

    Time is about linear in the length of a text and its spans. Defined cases: null texts count as empty and have no spans; repeated rows are marked each; disclosing
    terms inside a base span aren't marked again; an empty table gives no rows.
    """
    work = Scratch(docs.sparkSession, "pii")
    df = text_of(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = work.keep(disclosing_terms(df.select("text"), work), "terms")
    n = terms.count()
    blocks = max(1, -(-n // TERM_BLOCK))
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string, spans array<struct<from:int,kind:int,to:int>>"
    for k in range(blocks):
        part = terms if blocks == 1 else terms.where(F.pmod("term", F.lit(blocks)) == k)
        hashes = np.sort(np.fromiter((r["term"] for r in part.toLocalIterator()), np.int64).view(np.uint64))
        df = df.mapInArrow(_mark(hashes, k == 0), schema)
    work.drop()
    return df


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): base spans generalised to ``<KIND>``, disclosing terms removed."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                at, pieces = 0, []
                for s in spans:
                    if s["from"] >= at:
                        pieces += [text[at : s["from"]], f"<{KINDS[s['kind']].upper()}>" if s["kind"] < 4 else ""]
                        at = s["to"]
                out.append("".join([*pieces, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    df = personal_spans(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = personal_spans(load(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["from"].cast("string"), s["to"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return df.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
