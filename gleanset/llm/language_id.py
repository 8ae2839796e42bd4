"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is bound by multiplying its letters'
vectors, permuted (rotated) by their place; a document bundles (sums) its trigrams' vectors, and a
language's prototype bundles the normalised vectors of its training documents. A document gets the
language whose prototype has the largest cosine with it.

Scoring reads whole texts in one pass without a shuffle: a group of documents is a
documents-by-trigrams count matrix, multiplied with the vectors of the group's trigrams, ``COLUMNS`` of them at a
time. Prototypes are fitted on a sample of labelled rows of bounded size (``train_per_lang``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import load, quoted, text_of
from ._text import batches

DIMENSIONS = 1024
#: The item memory has so many letters, and 0 for what is no letter; a letter's place is its code point modulo this prime.
LETTERS = 8191
BITS = 13  # of a letter's place in a trigram's code
SEED = 11
#: About so many documents of each language are learned from (all, where a language has fewer).
TRAIN_PER_LANG = 1000
GROUP_DOCS = 512
COLUMNS = 2048
UNKNOWN = "und"

_cache: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """By code point: 0 for what is no letter, else the letter's place in the item memory."""
    if "letters" not in _cache:
        cps = np.arange(0x110000)
        is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _cache["letters"] = np.where(is_letter, cps % LETTERS + 1, 0).astype(np.int32)
    return _cache["letters"]


def item_memory(dimensions: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return (rng.integers(0, 2, (LETTERS + 1, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all letter trigrams, the text of each, and by text whether it has a letter.

    Texts are lower-cased; what is no letter counts as one boundary sign. The middle of a trigram is
    a letter, so that single letters have one too.
    """
    joined = "\n\n".join(t.lower() for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t.lower()) + 2 for t in texts])
    starts = np.cumsum(sizes) - sizes
    c = np.concatenate([[0], _letter_table()[cp], [0]]).astype(np.int64)
    middle = np.flatnonzero(c[1:-1]) + 1
    codes = (c[middle - 1] << 2 * BITS) | (c[middle] << BITS) | c[middle + 1]
    owner = np.searchsorted(starts, middle - 1, "right") - 1
    has = np.zeros(len(texts), bool)
    has[owner] = True
    return codes, owner, has


def vectors(codes: np.ndarray, memory: np.ndarray) -> np.ndarray:
    """The bound vectors of trigram codes."""
    letter = (1 << BITS) - 1
    return (np.roll(memory[codes >> 2 * BITS], 2, 1) * np.roll(memory[(codes >> BITS) & letter], 1, 1) * memory[codes & letter]).astype(np.float32)


def encode(texts: list[str], memory: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents' vectors of length 1 (0 without letters), and whether they have letters."""
    codes, owner, has = trigrams(texts)
    if not len(codes):
        return np.zeros((len(texts), memory.shape[1]), np.float32), has
    order = np.argsort(codes)
    codes, owner = codes[order], owner[order]
    new = np.append(True, codes[1:] != codes[:-1])
    distinct, column = codes[new], np.cumsum(new) - 1
    out = np.zeros((len(texts), memory.shape[1]), np.float32)
    for a in range(0, len(distinct), COLUMNS):
        width = min(COLUMNS, len(distinct) - a)
        i, j = np.searchsorted(column, (a, a + width))
        counts = np.bincount(owner[i:j] * width + column[i:j] - a, minlength=len(texts) * width).reshape(len(texts), width)
        out += counts.astype(np.float32) @ vectors(distinct[a : a + width], memory)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9), has


def _groups(parts: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for b in batches(parts, text):
        for a in range(0, b.num_rows, GROUP_DOCS):
            yield b.slice(a, GROUP_DOCS)


def held_out_rows(id_col: str = "doc_id", fold: int = 4, held: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``held``; a null id is not held out (and not learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == held, F.lit(False))


def drawn(id_col: str, class_col: str, counts: dict, most: dict) -> Column:
    """Whether a row is in a sample of about ``most[k]`` rows of each class k (of ``counts[k]``), by a 64-bit hash of its id."""
    limit = {k: min(2**63 - 1, -(2**63) + most[k] * 2**64 // n) for k, n in counts.items()}
    return F.xxhash64(id_col) <= F.create_map(*[F.lit(v) for kv in limit.items() for v in kv])[F.col(class_col)]


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, train_per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their prototypes, from (doc_id, text, lang); rows without lang, id or text are left out.

    The sample is drawn by a hash of the id, by language: what reaches the driver is a few vectors for
    each language.
    """
    rows = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, dimensions), np.float32)
    sample = rows.where(drawn("doc_id", "lang", counts, dict.fromkeys(counts, train_per_lang))).select("lang", "text")
    memory = item_memory(dimensions)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in _groups(parts):
            v, _ = encode(b.column("text").to_pylist(), memory)
            langs = np.array(b.column("lang").to_pylist())
            for k in np.unique(langs):
                total[k] = total.get(k, 0) + v[langs == k].sum(0, dtype=np.float64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(map(str, total), pa.string()), "v": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    sums = {k: np.zeros(dimensions) for k in counts}
    for r in sample.repartition(6).mapInArrow(run, "lang string, v binary").collect():
        sums[r["lang"]] += np.frombuffer(r["v"], np.float64)
    langs = sorted(k for k, v in sums.items() if v.any())
    p = np.array([sums[k] / np.linalg.norm(sums[k]) for k in langs], np.float32).reshape(-1, dimensions)
    return langs, p


def identify(df: DataFrame, langs: list[str], profiles: np.ndarray, text_col: str = "text", keep_text: bool = True, out: tuple[str, str] = ("__lang", "__cosine")) -> DataFrame:
    """``df`` with two more columns, named by ``out``: the language of the largest cosine, and that cosine, cut to 0..1.

    Ties go to the first language by name. Defined cases: null, empty and letterless texts are ``und``
    with 0, as is everything where nothing was learned; repeated rows are scored each; other columns pass
    unchanged.
    """
    memory = item_memory(profiles.shape[1])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(parts, text_col):
            v, has = encode([t or "" for t in b.column(text_col).to_pylist()], memory)
            if len(langs):
                cosine = v @ profiles.T
                best = cosine.argmax(1)
                score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0).astype(np.float64)
                pred = [langs[i] if h else UNKNOWN for i, h in zip(best.tolist(), has.tolist(), strict=True)]
            else:
                score, pred = np.zeros(len(has)), [UNKNOWN] * len(has)
            names = [c for c in b.schema.names if keep_text or c != text_col]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(pred, pa.string()), pa.array(score)], [*names, *out])

    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema if keep_text or f.name != text_col)
    return df.mapInArrow(run, f"{schema}, {quoted(out[0])} string, {quoted(out[1])} double")


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, train_per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Prototypes from the labelled rows of a documents table that are not held out."""
    labelled = docs.where(~held_out_rows()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return prototypes(labelled, dimensions, train_per_lang)


def language_id(docs: DataFrame, dimensions: int = DIMENSIONS, train_per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learned from the rows that are not held out.

    Defined cases: null, empty and letterless texts are ``und`` with 0; very long texts are bundled whole; ties go to the
    first language by name; rows without id are scored, not learned from; repeated rows are scored each; columns of other
    names aren't looked at; an empty table gives no rows.
    """
    langs, profiles = learn(docs, dimensions, train_per_lang)
    found = identify(text_of(docs, "doc_id", "text"), langs, profiles, keep_text=False)
    return found.select("doc_id", held_out_rows().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__cosine").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(load(spark, sf_dir, "documents"))
