"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own; two
neighbours are stitched at the first boundary that both have in their overlap. The pre-token pattern
has no look-behind, so from a common boundary on both scans agree; boundaries near a chunk's cut end
may be false (the pattern looks ahead) and are not trusted. Where an overlap has no common boundary
the left chunk is scanned on. Chunks of one text are split by ``THREADS`` threads at once. The pieces are then
encoded by merge ranks, the lowest rank first; decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import unicodedata
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._spark import load, text_of
from ._text import batches

CHUNK, OVERLAP = 1 << 16, 1 << 9
THREADS = 4
#: Pieces of more bytes are merged with a heap.
SHORT = 48
#: Beyond every rank.
NONE = 1 << 32
#: Pieces of texts repeat; so many encoded pieces are kept in a task.
CACHE = 300_000
#: Stand-ins for characters that libraries of different Unicode versions class differently: letter, number, space, other.
STAND_INS = ("\u0250", "0", "\u2003", "\u00a7")


class Codec:
    """Encoder and decoder for a file of ranks (base64 token, rank) and a pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = 1):
        import regex

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.find = regex.compile(pattern)
        self.rare = regex.compile(r"[^\x00-\u0377]")
        self.ranks = ranks
        self.pattern = pattern
        self.classes: dict[str, str] = {}
        self.library = None
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.chunk, self.overlap, self.threads = chunk, max(2, overlap), threads
        self.seen: dict[str, bytes] = {}

    def _ends(self, text: str, a: int, b: int) -> list[int]:
        """Where the pre-tokens of text[a:b] end; every character belongs to one."""
        return [m.end() + a for m in self.find.finditer(text[a:b], concurrent=self.threads > 1)]

    def bounds(self, text: str) -> list[int]:
        """The boundaries of the whole text's pre-tokens, by chunks that are stitched."""
        n, step = len(text), self.chunk - self.overlap
        cuts = [(a, min(n, a + self.chunk)) for a in range(0, max(1, n - self.overlap), max(1, step))]
        if self.threads > 1 and len(cuts) > 1:
            with ThreadPoolExecutor(self.threads) as pool:
                parts = list(pool.map(lambda c: self._ends(text, *c), cuts))
        else:
            parts = [self._ends(text, *c) for c in cuts]
        out = parts[0]
        for (a, _), right in zip(cuts[1:], parts[1:], strict=True):
            right_set = set(right)
            reach = cuts[0][1] if not out else max(out[-1], a)
            while True:
                # The last pre-tokens before a cut may change with what follows.
                trusted = out[:-2] if reach < n else out
                meet = next((i for i, e in self._from(trusted, a) if e in right_set), None)
                if meet is not None or reach >= n:
                    break
                kept = trusted[-1] if trusted else 0
                reach = min(n, max(reach, a + self.overlap) + self.chunk)
                out = trusted + self._ends(text, kept, reach)
            if meet is None:
                return out  # the left scan has reached the text's end
            e = out[meet]
            at = int(np.searchsorted(right, e, "right"))
            out = out[: meet + 1] + right[at:]
        return out

    @staticmethod
    def _from(ends: list[int], a: int) -> Iterator[tuple[int, int]]:
        i = int(np.searchsorted(ends, a, "right"))
        return ((j, ends[j]) for j in range(i, len(ends)))

    def view(self, text: str) -> str:
        """The text with a stand-in for every character that Python's Unicode tables don't know.

        Whether such a character is a letter depends on a library's Unicode version; the version of
        the encoding library decides. Positions don't change.
        """
        if not self.rare.search(text):
            return text
        odd = {c for c in set(text) if unicodedata.category(c) == "Cn"}
        return text.translate({ord(c): self._class(c) for c in odd}) if odd else text

    def _class(self, c: str) -> str:
        if c not in self.classes:
            if self.library is None:  # only tells how it classes characters that Python doesn't know
                import tiktoken

                self.library = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
            probe = f"a{c}1 {c} {c}{c}'s"
            want, one = self.library.encode_ordinary(probe), self.merged
            for k in STAND_INS:
                e = [m.end() for m in self.find.finditer(probe.replace(c, k))]
                if [i for a, b in zip([0, *e[:-1]], e, strict=True) for i in one(probe[a:b].encode())] == want:
                    break
            self.classes[c] = k
        return self.classes[c]

    def pieces(self, text: str) -> list[str]:
        view = self.view(text)
        if len(text) <= self.chunk and view is text:
            return self.find.findall(text)
        e = self.bounds(view)
        return [text[a:b] for a, b in zip([0, *e[:-1]], e, strict=True)]

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of a piece: again and again the neighbours of the lowest rank merge, the leftmost first."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > SHORT:
            return self._merged_long(piece)
        # at[i] is where the i-th part starts; rank[i] that of the i-th and the next part together.
        at, get = list(range(len(piece) + 1)), ranks.get
        rank = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while rank and (least := min(rank)) < NONE:
            i = rank.index(least)
            del at[i + 1], rank[i]
            if i:
                rank[i - 1] = get(piece[at[i - 1] : at[i + 1]], NONE)
            if i < len(rank):
                rank[i] = get(piece[at[i] : at[i + 2]], NONE)
        return [ranks[piece[a:b]] for a, b in zip(at, at[1:], strict=False)]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same for long pieces: a heap of pairs (rank, place), in which outdated pairs are passed over."""
        ranks, n = self.ranks, len(piece)
        end, left = list(range(1, n + 1)), list(range(-1, n))  # by where a part starts: its end, and where its left neighbour starts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] >= to or end[end[i]] != to:
                continue
            j = end[i]
            alive[j], end[i] = False, to
            if to < n:
                left[to] = i
                if (r := ranks.get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if i and (r := ranks.get(piece[left[i] : to])) is not None:
                heapq.heappush(heap, (r, left[i], to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Token ids, little-endian unsigned 32-bit integers."""
        seen, pieces = self.seen, self.pieces(text)
        try:
            return np.frombuffer(b"".join([seen[p] for p in pieces]), dtype="<u4")
        except KeyError:
            pass
        if len(seen) > CACHE:
            seen.clear()
        for p in set(pieces):
            if p not in seen:
                seen[p] = np.array(self.merged(p.encode("utf-8")), dtype="<u4").tobytes()
        return np.frombuffer(b"".join([seen[p] for p in pieces]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])


def codec(ranks_path: str, pattern: str) -> Codec:
    """A codec of one task: workers outlive it, and would hold its ranks and pieces beside those of later stages."""
    return Codec(ranks_path, pattern, threads=THREADS)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): each row's token ids as little-endian unsigned 32-bit integers.

    ``ranks_path`` is a file that every worker has. Null and empty texts have no tokens; repeated rows
    are encoded each; an empty table gives no rows. Special tokens are ordinary text.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches(parts):
            ids = [c.encode(t or "").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    df = text_of(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids binary")


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text binary): the raw bytes of each row's tokens, one after the other. Null ids: empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in parts:
            texts = [c.decode(np.frombuffer(x or b"", dtype="<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text binary")


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the texts.

    Defined cases: null and empty texts have no tokens; very long texts are split by chunks and stitched; of equal ranks the
    leftmost pair merges first; repeated rows are encoded each; other columns aren't looked at; an empty table gives no rows.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(ranks_path, pattern), lambda x: hashlib.sha256(x).hexdigest()
        for b in batches(parts):
            n, a, z = [], [], []
            for t in b.column("text").to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids))
                a.append(sha(ids.tobytes()))
                z.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    df = text_of(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary(ranks_path: str | None = None) -> tuple[str, str]:
    """The path of the ranks and the pre-token pattern that go with them."""
    import public_tokenizers

    return ranks_path or os.fspath(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(load(spark, sf_dir, "documents"), *vocabulary())
