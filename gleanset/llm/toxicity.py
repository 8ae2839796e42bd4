"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its word embedding (rare words share one) beside the mean of its (hashed) character-trigram
embeddings. Two gated recurrent layers read a window forwards and backwards, attention pools their
states, and a logistic unit scores the window. Windows overlap and cover the whole text; a document's
score is that of its worst window.

Labels hold for documents, not windows: training first gives every window its document's label, then
keeps of toxic documents only the windows that the model itself finds toxic (at least the worst one).
The network is fitted on the driver on a sample of labelled rows of bounded size (``TrainSize``);
scoring is one pass over all rows, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import load, text_of
from ._text import WORDS, Words, batches, utf8
from .language_id import drawn, held_out_rows

WINDOW, STRIDE = 32, 24
CHAR_ROWS = 1 << 12
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 12, 8


@dataclass(frozen=True)
class TrainSize:
    """Bounds of the training sample: about so many labelled documents of each class, of so many characters at most."""

    toxic: int = 900
    clean: int = 900
    chars: int = 100_000
    windows: int = 12  # of a document, in training
    epochs: int = 9
    batch: int = 256
    word_docs: int = 4  # a word has a row of its own if so many sampled documents have it; other words share row 0
    seed: int = 3
    rate: float = 0.02


@dataclass
class Features:
    """Words of a batch as table rows, and the mean of their character trigrams by rows and weights."""

    word: np.ndarray  # row of the word table; 0 for words without one
    grams: np.ndarray  # rows of the character table, all words' one after the other
    at: np.ndarray  # where each word's grams begin
    first: np.ndarray  # by document: its first word; n+1 entries


def unalike(texts: pa.Array) -> np.ndarray:
    """Places of texts with different smallest four-word shingles: one of each group of near copies."""
    h, owner = Words(*utf8(texts), WORDS).runs(4)
    least = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner, h)
    return np.sort(np.unique(least, return_index=True)[1])


def known_words(texts: pa.Array, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that ``least`` texts have, and the log-odds of toxic texts given each."""
    w = Words(*utf8(texts), WORDS)
    pairs = np.unique(np.stack([w.hash, w.doc.astype(np.uint64)], 1), axis=0) if len(w.hash) else np.zeros((0, 2), np.uint64)
    words, place, n = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
    toxic = np.bincount(place, y[pairs[:, 1].astype(int)], len(words))
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((n - toxic + 0.5) / ((1 - y).sum() + 1))
    return words[n >= least], odds[n >= least]


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(rows, values[:, k], len(out)).astype(out.dtype)


def features(texts: pa.Array, vocabulary: np.ndarray) -> Features:
    w = Words(*utf8(texts), WORDS)
    n = len(w.starts)
    size = w.ends - w.starts
    at = np.cumsum(size) - size
    if not n:
        return Features(np.zeros(0, np.int32), np.zeros(0, np.int32), at, w.first)
    # The bytes of words only, with what stands before and after inside the word (0 at its ends).
    inside = np.arange(int(size.sum())) + np.repeat(w.starts - at, size)
    mid = w.data[inside].astype(np.uint32)
    left, right = np.zeros_like(mid), np.zeros_like(mid)
    left[1:], right[:-1] = mid[:-1], mid[1:]
    left[at] = 0
    right[at + size - 1] = 0
    grams = ((left * 65599 + mid * 2654435 + right * 40503 * 31) * np.uint32(2654435761)) >> np.uint32(20)
    row = np.zeros(n, np.int32)
    if len(vocabulary):
        place = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
        row = np.where(vocabulary[place] == w.hash, place + 1, 0).astype(np.int32)
    return Features(row, grams.astype(np.int32), at, w.first)


def windows(first: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of overlapping windows that cover every word; the last ends with the document."""
    n = np.diff(first)
    many = np.where(n == 0, 0, np.maximum(0, -(-(n - window) // stride)) + 1)
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(n[doc], window)
    return doc, first[doc] + np.minimum(k * stride, n[doc] - size), size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @classmethod
    def fresh(cls, seed: int, vocabulary: np.ndarray = np.zeros(0, np.uint64)) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s, scale=1.0: (rng.standard_normal(s) * scale).astype(np.float32)
        e, h = WORD_DIM + CHAR_DIM, HIDDEN
        p = {"word": g(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": g(CHAR_ROWS, CHAR_DIM, scale=0.3)}
        for d in "fb":
            p |= {f"wx{d}": g(e, 3 * h, scale=e**-0.5), f"wh{d}": g(h, 3 * h, scale=h**-0.5), f"bx{d}": np.zeros(3 * h, np.float32)}
        p |= {"wa": g(2 * h, ATTENTION, scale=(2 * h) ** -0.5), "ba": np.zeros(ATTENTION, np.float32), "ua": g(ATTENTION, scale=0.3), "wo": g(2 * h, scale=(2 * h) ** -0.5), "bo": np.zeros(1, np.float32)}
        return cls(p, vocabulary)

    def inputs(self, f: Features) -> np.ndarray:
        """By word: the word's embedding beside the mean of its character trigrams'."""
        if not len(f.word):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        size = np.diff(np.append(f.at, len(f.grams))).astype(np.float32)
        chars = np.add.reduceat(self.p["char"][f.grams], f.at, axis=0) / size[:, None]
        return np.concatenate([self.p["word"][f.word], chars], 1)

    def _direction(self, x: np.ndarray, mask: np.ndarray | None, d: str, keep: bool):
        """States (T, N, H) of projected inputs x (T, N, 3H); ``keep`` holds what the gradient needs."""
        t_, n, h = x.shape[0], x.shape[1], HIDDEN
        wh = self.p[f"wh{d}"]
        out, saved = np.zeros((t_, n, h), np.float32), []
        s = np.zeros((n, h), np.float32)
        for t in range(t_) if d == "f" else range(t_ - 1, -1, -1):
            u = s @ wh
            a = x[t]
            zr = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * h] + u[:, : 2 * h]))
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            new = c + z * (s - c)
            if mask is not None:
                new = np.where(mask[t][:, None], new, s)
            if keep:
                saved.append((t, s, z, r, c, u[:, 2 * h :]))
            out[t] = s = new
        return out, saved

    def forward(self, x: np.ndarray, at: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows; x holds all words' inputs, a window the words at..at+size."""
        t_ = int(size.max())
        step = np.arange(t_)[:, None]
        full = bool((size == t_).all())
        mask = None if full else step < size[None, :]
        idx = np.minimum(at[None, :] + step, len(x) - 1)
        states, saved = [], {}
        for d in "fb":
            projected = x @ self.p[f"wx{d}"] + self.p[f"bx{d}"]
            s, saved[d] = self._direction(projected[idx], mask, d, keep)
            states.append(s)
        h = np.concatenate(states, 2)
        a = np.tanh(h @ self.p["wa"] + self.p["ba"])
        e = a @ self.p["ua"]
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, h)
        logit = pooled @ self.p["wo"] + self.p["bo"]
        return logit, (idx, mask, saved, h, a, w, pooled) if keep else None

    def gradient(self, f: Features, x: np.ndarray, at: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of windows and its gradient by parameter."""
        p, h_ = self.p, HIDDEN
        logit, (idx, mask, saved, h, a, w, pooled) = self.forward(x, at, size, True)
        prob = _sigmoid(logit)
        n = len(y)
        g = {"bo": np.zeros(1, np.float32)}
        dl = ((prob - y) / n).astype(np.float32)
        g["bo"][0], g["wo"] = dl.sum(), pooled.T @ dl
        dp = dl[:, None] * p["wo"]
        dh = w[:, :, None] * dp[None]
        dw = np.einsum("nh,tnh->tn", dp, h)
        de = w * (dw - (w * dw).sum(0))
        g["ua"] = np.einsum("tn,tna->a", de, a)
        da = de[:, :, None] * p["ua"] * (1 - a * a)
        g["ba"], g["wa"] = da.sum((0, 1)), h.reshape(-1, 2 * h_).T @ da.reshape(-1, ATTENTION)
        dh += da @ p["wa"].T
        dx = np.zeros((*idx.shape, x.shape[1]), np.float32)
        for k, d in enumerate("fb"):
            wh, carry = p[f"wh{d}"], np.zeros((n, h_), np.float32)
            gwh, dproj = np.zeros_like(wh), np.zeros((*idx.shape, 3 * h_), np.float32)
            for t, s, z, r, c, un in reversed(saved[d]):
                ds = dh[t, :, k * h_ : (k + 1) * h_] + carry
                on = None if mask is None else mask[t][:, None]
                live = ds if on is None else np.where(on, ds, 0)
                dz, dc = live * (s - c) * z * (1 - z), live * (1 - z) * (1 - c * c)
                dr = dc * un * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], 1)
                gwh += s.T @ du
                carry = live * z + du @ wh.T + (0 if on is None else np.where(on, 0, ds))
                dproj[t, :, : 2 * h_], dproj[t, :, 2 * h_ :] = du[:, : 2 * h_], dc
            g[f"wh{d}"] = gwh
            flat = dproj.reshape(-1, 3 * h_)
            g[f"wx{d}"], g[f"bx{d}"] = x[idx].reshape(-1, x.shape[1]).T @ flat, flat.sum(0)
            dx += dproj @ p[f"wx{d}"].T
        per_word = np.zeros_like(x)
        _add_rows(per_word, idx.ravel(), dx.reshape(-1, x.shape[1]))
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        used = np.unique(idx)
        _add_rows(g["word"], f.word[used], per_word[used, :WORD_DIM])
        sizes = np.diff(np.append(f.at, len(f.grams)))
        inner = np.arange(int(sizes[used].sum())) - np.repeat(np.cumsum(sizes[used]) - sizes[used], sizes[used])
        _add_rows(g["char"], f.grams[np.repeat(f.at[used], sizes[used]) + inner], np.repeat(per_word[used, WORD_DIM:] / sizes[used, None], sizes[used], 0))
        loss = -np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))
        return float(loss), g

    def scores(self, f: Features, docs: int, most: int = 2048) -> np.ndarray:
        """By document: the largest logit of its windows; -inf without words."""
        out = np.full(docs, -np.inf)
        doc, at, size = windows(f.first)
        x = self.inputs(f)
        for s in (size == WINDOW, size < WINDOW):
            rows = np.flatnonzero(s)
            for a in range(0, len(rows), most):
                r = rows[a : a + most]
                np.maximum.at(out, doc[r], self.forward(x, at[r], size[r])[0])
        return out


class Adam:
    def __init__(self, rate: float, decay: float = 0.01):
        self.rate, self.decay, self.t, self.m, self.v = rate, decay, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * x * x
            p[k] -= (self.rate * self.decay * p[k]).astype(np.float32)
            p[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def fit(texts: list[str], labels: list[int], size: TrainSize = TrainSize()) -> Network:
    """A network fitted on labelled texts; its last bias puts the best cut of the training documents at 0.5."""
    column = pa.array(texts, pa.large_string())
    apart = unalike(column)
    column, y = column.take(pa.array(apart)), np.array(labels, np.float32)[apart]
    words, odds = known_words(column, y, size.word_docs)
    net, rng = Network.fresh(size.seed, words), np.random.Generator(np.random.PCG64(size.seed))
    if len({*y.tolist()}) < 2:
        net.p["wo"][:] = 0
        net.p["bo"][:] = 4.0 if len(y) and y.min() > 0 else -4.0
        return net
    f = features(column, net.vocabulary)
    # A fifth of the documents only decides where the cut lies.
    aside = rng.permutation(len(y)) % 5 == 0
    if len({*y[aside]}) < 2 or len({*y[~aside]}) < 2:
        aside = np.zeros(len(y), bool)
    doc, at, length = windows(f.first)
    kept = np.zeros(len(doc), bool)
    for d in np.unique(doc):
        mine = np.arange(np.searchsorted(doc, d), np.searchsorted(doc, d, "right"))
        kept[mine if len(mine) <= size.windows or y[d] else rng.choice(mine, size.windows, False)] = True
    kept &= ~aside[doc]
    doc, at, length = doc[kept], at[kept], length[kept]
    # To begin with, a toxic document's toxic windows are those with its most telling word.
    tell = np.append(0.0, odds)[f.word]
    span = np.minimum(at[:, None] + np.arange(WINDOW), len(tell) - 1)
    told = np.where(np.arange(WINDOW) < length[:, None], tell[span], -np.inf).max(1) if len(at) else np.zeros(0)
    most = np.full(len(y), -np.inf)
    np.maximum.at(most, doc, told)
    use = (y[doc] == 0) | (told >= np.minimum(most[doc], 3.0))
    adam = Adam(size.rate)
    for epoch in range(size.epochs):
        if epoch in (size.epochs // 3, size.epochs // 2, size.epochs - 2):  # the model's own view of which windows of toxic documents are toxic
            logit = _in_parts(net, f, at, length)
            worst = np.full(len(y), -np.inf)
            np.maximum.at(worst, doc, logit)
            use = (y[doc] == 0) | (logit >= worst[doc] - 1e-6) | (logit > 0)
        adam.rate = size.rate * (1 if epoch < size.epochs - 2 else 0.3)
        toxic, clean = np.flatnonzero(use & (y[doc] == 1)), np.flatnonzero(use & (y[doc] == 0))
        # Each epoch has as many toxic windows as half the clean ones at least.
        if len(toxic):
            toxic = rng.choice(toxic, max(len(toxic), len(clean) // 2)) if len(toxic) < len(clean) // 2 else toxic
        order = rng.permutation(np.concatenate([toxic, clean]))
        for a in range(0, len(order), size.batch):
            rows = order[a : a + size.batch]
            local, lat = _gather(f, at[rows], length[rows])
            _, g = net.gradient(local, net.inputs(local), lat, length[rows], y[doc[rows]])
            adam.step(net.p, g)
    judged = aside if aside.any() else ~aside
    scores, truth = np.clip(net.scores(f, len(y)), -20, 20)[judged], y[judged]
    order = np.argsort(scores, kind="stable")
    # Errors of each cut, both classes weighing the same.
    missed = np.concatenate([[0], np.cumsum(truth[order])]) / truth.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(1 - truth[order])]) / (1 - truth).sum()
    cut = int(np.argmin(missed + wrong))
    s = scores[order]
    left, right = s[max(0, cut - 1)], s[min(cut, len(s) - 1)]
    net.p["bo"] -= np.float32((left + right) / 2)
    return net


def _gather(f: Features, at: np.ndarray, length: np.ndarray) -> tuple[Features, np.ndarray]:
    """The features of some windows alone, and where they begin there."""
    begin = np.cumsum(length) - length
    words = np.arange(int(length.sum())) + np.repeat(at - begin, length)
    sizes = np.diff(np.append(f.at, len(f.grams)))[words]
    gat = np.cumsum(sizes) - sizes
    grams = f.grams[np.arange(int(sizes.sum())) + np.repeat(f.at[words] - gat, sizes)]
    return Features(f.word[words], grams, gat, begin), begin


def _in_parts(net: Network, f: Features, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    out, x = np.zeros(len(at), np.float32), net.inputs(f)
    for a in range(0, len(at), 2048):
        out[a : a + 2048] = net.forward(x, at[a : a + 2048], length[a : a + 2048])[0]
    return out


def train(docs: DataFrame, labels: DataFrame, size: TrainSize = TrainSize()) -> Network:
    """Fit on a bounded sample of the labelled rows with crc32(doc_id as text) mod 5 other than 0."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out_rows("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return fit([], [], size)
    most = {0: size.clean, 1: size.toxic}
    picked = known.where(drawn("doc_id", "toxic", counts, most))
    # Its size is bounded by the sample's: about size.toxic + size.clean ids.
    texts = text_of(docs, "doc_id", "text").where(F.char_length("text") <= size.chars)
    # An id with several texts has the label for all of them; the smallest text is learned from.
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], size)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row and whole text: the largest window's probability, 0 to 1.

    Defined cases: null, empty and wordless texts score 0; repeated rows are scored each; an empty table
    gives no rows.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            f = features(b.column("text"), net.vocabulary)
            s = net.scores(f, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.where(np.isinf(s), 0.0, _sigmoid(np.where(np.isinf(s), 0, s))))], ["doc_id", "score"])

    df = text_of(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, size: TrainSize = TrainSize()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Defined cases: null, empty and wordless texts score 0; very long texts are scored by all their windows; rows without id
    are scored, not learned from; of contradicting labels of an id the toxic one holds; other columns aren't looked at;
    without labels, or with those of one class, all scores are that class's; an empty table gives no rows.
    """
    return score(docs, train(docs, labels, size)).select("doc_id", held_out_rows("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
