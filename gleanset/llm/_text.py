"""Vectorised text kernels for Arrow batches: words, their 64-bit hashes, shingles.

Texts stay UTF-8 bytes; a batch is one byte array with document offsets. Nothing here loops over
words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Batches hold at most so many bytes of text, or one document.
BATCH_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240917))
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15 | 1)
_STEP_INV = U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def batches(parts: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches whose texts have ``limit`` bytes at most (or are one document)."""
    for b in parts:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(size):
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and the n+1 offsets. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, np.uint8)
    return d, o - o[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, kept between calls up to a batch's size."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    out = []
    for s in (_STEP, _STEP_INV):
        a = np.full(n, s, U)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    if n <= 2 * BATCH_BYTES:
        _powers[:] = out
    return out[0], out[1]


class Words:
    """The words of a batch: byte ranges, hashes, and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashes: bool = True):
        self.data, self.offsets = LOWER[data], offsets
        n = len(data)
        m = is_word[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = m[:-1], m[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = False
        after[inner - 1] = False
        self.starts = np.flatnonzero(m & ~before)
        self.ends = np.flatnonzero(m & ~after) + 1
        #: doc d has the words first[d] to first[d + 1]
        self.first = np.searchsorted(self.starts, offsets)
        if hashes:
            self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U)
        up, down = powers(len(self.data) + 1)
        c = np.zeros(len(self.data) + 1, U)
        np.cumsum(_LETTER[self.data] * up[:-1], out=c[1:])
        h = (c[self.ends] - c[self.starts]) * down[self.starts]
        return mix(h ^ (self.ends - self.starts).astype(U))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words inside a document, and the document of each.

        A document of fewer words, but not none, has its whole sequence as one run.
        """
        n, doc = len(self.hash), self.doc
        out, owner = np.zeros(0, U), np.zeros(0, np.int64)
        if n >= k:
            h = np.zeros(n - k + 1, U)
            for j in range(k):
                h = h * _STEP + self.hash[j : n - k + 1 + j]
            inside = doc[: n - k + 1] == doc[k - 1 :]
            out, owner = mix(h[inside] + U(k)), doc[: n - k + 1][inside]
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if len(short):
            h = np.zeros(len(short), U)
            for j in range(k - 1):
                on = self.counts[short] > j
                h[on] = h[on] * _STEP + self.hash[self.first[short[on]] + j]
            out = np.concatenate([out, mix(h + self.counts[short].astype(U))])
            owner = np.concatenate([owner, short])
        return out, owner


def byte_class(spans: list[tuple[int, int]], of: bool = True) -> np.ndarray:
    """A table of 256 booleans: ``of`` inside the inclusive spans, its opposite elsewhere."""
    t = np.full(256, not of)
    for a, b in spans:
        t[a : b + 1] = of
    return t


#: `[^\x20\x09-\x0D]+`
NON_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)], False)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], False)
