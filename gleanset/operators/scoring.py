"""Scorers: class-probabilities of points, and the losses and gradients that follow.

``Centroid`` is a linear softmax whose logits are -|x - mu_c|^2 / tau, fitted by one aggregate. ``Mlp`` is a numpy perceptron
for coreset-sized training sets. Both score whole Arrow batches by matrix operations (nested array lambdas would
evaluate each logit many times); what follows from the C probabilities of a row is Column expressions.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.functions import vectors as V
from gleanset.functions.hashing import hash_int
from gleanset.operators import stats
from gleanset.operators.distance import kinds, matrix, sq_dists

TAU = 0.1


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if z.size else z
    return e / e.sum(1, keepdims=True) if z.size else z


@dataclass(frozen=True)
class Centroid:
    """Means of classes 0..C-1 (a class without rows has none and probability 0)."""

    means: tuple[tuple[float, ...] | None, ...]
    tau: float = TAU

    @classmethod
    def fit(cls, points: DataFrame, n_classes: int, tau: float = TAU, weight: str | None = None) -> Centroid:
        d = stats.width(points)
        w = F.col(weight) if weight else None
        of = F.avg if w is None else (lambda x: F.sum(x * w) / F.sum(w))
        rows = points.groupBy("label").agg(V.column_aggregates("features", d, of).alias("m")).collect()  # C rows
        by = {r["label"]: tuple(r["m"]) for r in rows}
        return cls(tuple(by.get(c) for c in range(n_classes)), tau)

    @property
    def classes(self) -> int:
        return len(self.means)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), len(self.means)), -1e9)
        for c, m in enumerate(self.means):
            if m is not None and len(x):
                out[:, c] = -sq_dists(x, np.array([m]))[:, 0] / self.tau
        return out

    def probs(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x))

    def weights(self) -> np.ndarray:
        """The linear softmax's weights: W_c = 2 mu_c / tau."""
        d = len(next(m for m in self.means if m))
        return np.array([np.zeros(d) if m is None else np.array(m) for m in self.means]) * (2 / self.tau)

    def input_gradient(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """d(cross-entropy with the target q) / dx = W^T (p - q)."""
        return (self.probs(x) - q) @ self.weights()


def with_arrays(points: DataFrame, out: dict[str, tuple[str, Callable]], features: str = "features") -> DataFrame:
    """Adds columns made by numpy from the feature matrix of each batch: name to (type, function of matrix and batch)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = matrix(b.column(features))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(f(x, b)) if b.num_rows else pa.array([], _types[t]) for t, f in out.values()]], [*b.schema.names, *out])

    return points.mapInArrow(run, kinds(points) + "".join(f", `{n}` {t}" for n, (t, _) in out.items()))


_types = {"array<double>": pa.list_(pa.float64()), "double": pa.float64(), "int": pa.int32(), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}


def snapshots(points: DataFrame, n_classes: int, n: int, salt: int | str = "snap", tau: float = TAU) -> list[Centroid]:
    """n scorers, each fitted without one hash fold of the rows: stand-ins for a model at several epochs."""
    fold = F.pmod(hash_int("row_id", salt), F.lit(n))
    return [Centroid.fit(points.where(fold != k), n_classes, tau) for k in range(n)]


def with_probs(points: DataFrame, model, out: str = "probs", features: str = "features") -> DataFrame:
    return with_arrays(points, {out: ("array<double>", lambda x, _: model.probs(x).tolist())}, features)


def loss(probs: Column, label: Column) -> Column:
    """-log of the label's probability, which is cut at 1e-12."""
    return -F.ln(F.greatest(V.at(probs, label), F.lit(1e-12)))


def residual(probs: Column, label: Column, n_classes: int) -> Column:
    """The last layer's gradient p - q for a hard label, cut to -1..1."""
    return V.clip(V.sub(probs, V.one_hot(label, n_classes)))


def soft_loss(probs: Column, soft: Column) -> Column:
    """The cross-entropy of a soft target."""
    return V.cross_entropy(probs, soft)


def last_layer_gradient(probs: Column, label: Column, n_classes: int, hidden: Column) -> Column:
    """(p - q) followed by all products (p - q) x h."""
    r = V.sub(probs, V.one_hot(label, n_classes))
    return F.concat(r, V.outer(r, hidden))


def snapshot_losses(points: DataFrame, models: list, features: str = "features", target: str | None = None) -> DataFrame:
    """Adds ``losses`` (by snapshot), ``mean_loss`` and the population deviation ``std_loss``, in one pass.

    ``target`` names a column of soft targets; without it, the label counts.
    """

    def of(x, b):
        if target:
            q = matrix(b.column(target))
            return np.stack([-(q * np.log(np.maximum(m.probs(x), 1e-12))).sum(1) for m in models], 1).tolist()
        y = np.array(b.column("label").to_pylist())
        return np.stack([-np.log(np.maximum(m.probs(x)[np.arange(len(y)), y], 1e-12)) for m in models], 1).tolist()

    out = with_arrays(points, {"losses": ("array<double>", of)}, features)
    return out.withColumn("mean_loss", V.mean(F.col("losses"))).withColumn("std_loss", V.std_pop(F.col("losses")))


def class_losses(points: DataFrame, models: list) -> DataFrame:
    """Adds ``class_losses``: by class the mean over snapshots of -log p."""
    of = lambda x, _: np.mean([-np.log(np.maximum(m.probs(x), 1e-12)) for m in models], 0).tolist()
    return with_arrays(points, {"class_losses": ("array<double>", of)})


def input_gradients(points: DataFrame, models: list, target: str | None = None) -> DataFrame:
    """Adds ``gradient``: the mean over snapshots of d(cross-entropy) / dx, for the label or a column of soft targets."""

    def of(x, b):
        q = matrix(b.column(target)) if target else np.eye(models[0].classes)[np.array(b.column("label").to_pylist())]
        return np.mean([m.input_gradient(x, q) for m in models], 0).tolist()

    return with_arrays(points, {"gradient": ("array<double>", of)})


def out_of_fold(folded: DataFrame, n_classes: int, folds: int, tau: float = TAU) -> DataFrame:
    """Adds ``probs`` of each row by the scorer that was fitted without its fold."""
    models = [Centroid.fit(folded.where(F.col("fold") != k), n_classes, tau) for k in range(folds)]

    def of(x, b):
        fold = np.array(b.column("fold").to_pylist())
        out = np.zeros((len(x), n_classes))
        for k, m in enumerate(models):
            out[fold == k] = m.probs(x[fold == k])
        return out.tolist()

    return with_arrays(folded, {"probs": ("array<double>", of)})


def deepfool_margin(points: DataFrame, model: Centroid) -> DataFrame:
    """Adds ``predicted`` and ``margin``: the distance to the nearest class boundary of a linear softmax, in closed form.

    min over k of |f_k - f_0| / |w_k - w_0|, with f_0 the predicted class; all other classes are looked at.
    """
    w = model.weights()
    far = np.sqrt(sq_dists(w, w))
    has = np.array([m is not None for m in model.means])

    def of(x, _):
        z = model.logits(x)
        top = z.argmax(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where((far[top] > 0) & has, np.abs(z - z.max(1, keepdims=True)) / far[top], np.inf)
        return d.min(1)

    return with_arrays(points, {"predicted": ("int", lambda x, _: model.logits(x).argmax(1).astype(np.int32)), "margin": ("double", of)})


class Mlp:
    """A perceptron with ReLU layers and dropout, trained by AdamW on (soft) weighted cross-entropy, in numpy.

    With ``norm`` each hidden layer is normalised by its batch in training (a batch of one row: by the running values) and by the
    running mean and variance in scoring.
    """

    def __init__(self, d: int, n_classes: int, hidden: tuple[int, ...] = (64, 32), dropout: float = 0.2, seed: int = 42, norm: bool = False):
        rng = np.random.default_rng(seed)
        sizes = [d, *hidden, n_classes]
        self.w = [rng.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        inner = hidden if norm else ()
        self.scale, self.shift = [np.ones(b) for b in inner], [np.zeros(b) for b in inner]
        self.mean, self.var = [np.zeros(b) for b in inner], [np.ones(b) for b in inner]
        self.dropout, self.rng, self.t = dropout, rng, 0
        self.m = [np.zeros_like(p) for p in self.learned]
        self.v = [np.zeros_like(p) for p in self.learned]

    @property
    def classes(self) -> int:
        return len(self.b[-1])

    @property
    def learned(self) -> tuple[np.ndarray, ...]:
        return (*self.w, *self.b, *self.scale, *self.shift)

    @property
    def arrays(self) -> tuple[np.ndarray, ...]:
        """Parameters, both moments and running values."""
        return (*self.learned, *self.m, *self.v, *self.mean, *self.var)

    def state(self) -> np.ndarray:
        """All arrays as one vector."""
        return np.concatenate([p.ravel() for p in self.arrays])

    def with_state(self, state: np.ndarray, t: int, seed) -> Mlp:
        """A perceptron of the same shape with these arrays, after t steps."""
        out = copy.deepcopy(self)
        at = 0
        for p in out.arrays:
            p[...] = state[at : at + p.size].reshape(p.shape)
            at += p.size
        out.t, out.rng = t, np.random.default_rng(seed)
        return out

    def _slope(self, i: int) -> np.ndarray:
        return self.scale[i] / np.sqrt(self.var[i] + 1e-5)

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        """The input and the values of each hidden layer, as in scoring."""
        out = [np.asarray(x, float)]
        for i, (w, b) in enumerate(zip(self.w[:-1], self.b[:-1], strict=True)):
            z = out[-1] @ w + b
            if self.scale:
                z = (z - self.mean[i]) * self._slope(i) + self.shift[i]
            out.append(np.maximum(z, 0))
        return out

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return self.layers(x)[-1]

    def probs(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.hidden(x) @ self.w[-1] + self.b[-1])

    def input_gradient(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """d(cross-entropy with the target q) / dx, as in scoring."""
        acts = self.layers(x)
        g = (softmax(acts[-1] @ self.w[-1] + self.b[-1]) - q) @ self.w[-1].T
        for i in range(len(self.w) - 2, -1, -1):
            g = g * (acts[i + 1] > 0)
            g = (g * self._slope(i) if self.scale else g) @ self.w[i].T
        return g

    def step(self, x: np.ndarray, q: np.ndarray, weight: np.ndarray, rate: float, decay: float) -> float:
        """One AdamW step on a batch; the weighted mean loss."""
        acts, masks, normed = [x], [], []
        for i, (w, b) in enumerate(zip(self.w[:-1], self.b[:-1], strict=True)):
            mask = (self.rng.random((len(x), w.shape[1])) >= self.dropout) / max(1e-9, 1 - self.dropout)
            masks.append(mask)
            z = acts[-1] @ w + b
            if self.scale:
                mean, var = (z.mean(0), z.var(0)) if len(x) > 1 else (self.mean[i], self.var[i])
                spread = np.sqrt(var + 1e-5)
                normed.append(((z - mean) / spread, spread))
                if len(x) > 1:
                    self.mean[i] = 0.9 * self.mean[i] + 0.1 * mean
                    self.var[i] = 0.9 * self.var[i] + 0.1 * var * len(x) / (len(x) - 1)
                z = normed[-1][0] * self.scale[i] + self.shift[i]
            acts.append(np.maximum(z, 0) * mask)
        z = acts[-1] @ self.w[-1] + self.b[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        k = weight / max(1e-12, weight.sum())
        g, gw, gb, gs, gc = (p - q) * k[:, None], [], [], [], []
        for i in range(len(self.w) - 1, -1, -1):
            gw.insert(0, acts[i].T @ g)
            gb.insert(0, g.sum(0))
            if i:
                g = (g @ self.w[i].T) * (acts[i] > 0) * masks[i - 1]
                if self.scale:
                    u, spread = normed[i - 1]
                    gs.insert(0, (g * u).sum(0))
                    gc.insert(0, g.sum(0))
                    g = g * self.scale[i - 1]
                    g = (g - g.mean(0) - u * (g * u).mean(0) if len(x) > 1 else g) / spread
        self.t += 1
        for i, (param, grad) in enumerate(zip(self.learned, (*gw, *gb, *gs, *gc), strict=True)):
            self.m[i] = 0.9 * self.m[i] + 0.1 * grad
            self.v[i] = 0.999 * self.v[i] + 0.001 * grad * grad
            param -= rate * (self.m[i] / (1 - 0.9**self.t) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8) + decay * param)
        return float(-(k * (q * np.log(np.maximum(p, 1e-12))).sum(1)).sum())

    def epoch(self, x: np.ndarray, q: np.ndarray, weight: np.ndarray, batch: int = 1024, rate: float = 1e-3, decay: float = 1e-4) -> float:
        order, total = self.rng.permutation(len(x)), 0.0
        for a in range(0, len(x), batch):
            i = order[a : a + batch]
            total += self.step(x[i], q[i], weight[i], rate, decay) * weight[i].sum()
        return total / max(1e-12, weight.sum())

    def fit(self, x, q, weight=None, epochs: int = 300, batch: int = 1024, rate: float = 1e-3, decay: float = 1e-4, patience: int = 50, min_delta: float = 1e-4) -> list[float]:
        """Epochs until the training loss hasn't fallen by min_delta for ``patience`` of them; the loss history."""
        x, q = np.asarray(x, float), np.asarray(q, float)
        weight = np.ones(len(x)) if weight is None else np.asarray(weight, float)
        best, bad, history = np.inf, 0, []
        for _ in range(epochs):
            history.append(self.epoch(x, q, weight, batch, rate, decay))
            best, bad = (history[-1], 0) if history[-1] < best - min_delta else (best, bad + 1)
            if bad >= patience:
                break
        return history
