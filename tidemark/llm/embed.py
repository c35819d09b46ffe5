"""Averaged hashed subword embeddings with a linear softmax.

A document is the mean of the learned vectors of its hashed character n-grams (and words), fed
to a softmax layer. Training is stochastic gradient descent in numpy on a bounded sample;
scoring runs on Spark over Arrow batches. As averaging and the last layer are both linear,
scoring folds them into one table of a row per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches

#: Characters that are hashed at a time; longer texts are cut at a space for hashing and summed.
PIECE = 1 << 18
_PAD = "\0\0\0"


@dataclass(frozen=True)
class Features:
    """Which hashed features a text has: n-grams of these orders over its characters, and words."""

    bits: int = 13
    orders: tuple[int, ...] = (1, 2, 3, 4)
    words: bool = False
    lower: bool = True

    @property
    def size(self) -> int:
        return 1 << self.bits

    def _mix(self, h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        h *= np.uint32(0x297A2D39)
        return h >> np.uint32(32 - self.bits)

    def streams(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, bucket) arrays for code points ``c``, in which zeros part the documents."""
        for n in self.orders:
            if len(c) < n:
                continue
            m = len(c) - n + 1
            h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h += c[k : k + m]
            at = np.flatnonzero((c[:m] != 0) & (c[n - 1 :] != 0))
            yield at, self._mix(h[at])
        if self.words:
            inside = (c > 32) & (c != 0xA0)
            starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
            if len(starts):
                chars = np.flatnonzero(inside)
                first = np.searchsorted(chars, starts)
                within = np.arange(len(chars)) - np.repeat(first, np.diff(np.append(first, len(chars))))
                power = np.cumprod(np.full(64, 0x01000193, np.uint32), dtype=np.uint32)[within & 63]
                word = np.add.reduceat((c[chars] + np.uint32(0x9E37)) * power, first, dtype=np.uint32)
                document = np.cumsum(c == 0)[starts]
                again = 1 + np.flatnonzero((word[1:] == word[:-1]) & (document[1:] == document[:-1]))
                yield starts, self._mix(word)
                yield starts[again], np.full(len(again), 1, np.uint32)  # a word that follows itself is a feature of its own

    def pieces(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document numbers, their starts, code points) for runs of texts of about PIECE characters."""
        run: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            text = (text or "").replace("\0", " ")
            text = text.lower() if self.lower else text
            while text:
                cut = len(text) if len(text) <= PIECE else (text.rfind(" ", PIECE // 2, PIECE) + 1 or PIECE)
                run.append((i, text[:cut]))
                size += cut
                text = text[cut:]
                if size >= PIECE:
                    yield self._run(run)
                    run, size = [], 0
        if run:
            yield self._run(run)

    @staticmethod
    def _run(run: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(t) + len(_PAD) for _, t in run])
        c = np.frombuffer((_PAD.join(t for _, t in run) + _PAD).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.array([i for i, _ in run]), np.concatenate([[0], np.cumsum(lengths)[:-1]]), c

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A text's distinct buckets and how often each occurs."""
        total = np.zeros(self.size, np.float32)
        for _, _, c in self.pieces([text]):
            for _, bucket in self.streams(c):
                total += np.bincount(bucket, minlength=self.size)
        at = np.flatnonzero(total)
        return at, total[at]


@dataclass(frozen=True)
class Model:
    """``table``: a row a bucket, a column a class; ``bias``; ``temperature`` divides the logits."""

    features: Features
    classes: tuple
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, texts: Sequence[str | None]) -> np.ndarray:
        total, n = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        columns = np.ascontiguousarray(self.table.T)
        for number, starts, c in self.features.pieces(texts):
            for at, bucket in self.features.streams(c):
                if not len(at):
                    continue
                cuts = np.searchsorted(at, starts)
                full = np.diff(np.append(cuts, len(at)))
                some = full > 0
                np.add.at(n, number[some], full[some])
                for k, column in enumerate(columns):
                    np.add.at(total[:, k], number[some], np.add.reduceat(column[bucket], cuts[some]))
        return total / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, texts: Sequence[str | None]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: Sequence[str | None], labels: Sequence, features: Features, dim: int = 16, epochs: int = 8, rate: float = 0.3, batch: int = 64, seed: int = 7, reject_share: float = 0.002) -> Model:
    """Fit by stochastic gradient descent; a fifth of the sample sets temperature, bias and rejection.

    Step sizes shrink by parameter with the gradients seen so far. The rejection limit is the
    ``reject_share`` quantile of the confidence in held-back documents that were classified
    rightly. Under five texts none can be held back and those learned from are taken instead;
    without any there is a model of no classes. The result depends on the order of ``texts``
    and on ``seed`` only.
    """
    classes = tuple(sorted(set(labels)))
    if not classes:
        return Model(features, (), np.zeros((features.size, 0)), np.zeros(0))
    y = np.array([classes.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    rows = [features.counts(t) for t in texts]
    order = rng.permutation(len(rows))
    held, learn = order[: len(rows) // 5], order[len(rows) // 5 :].copy()
    e = rng.normal(0, 0.1, (features.size, dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, len(classes))).astype(np.float32)
    b = np.log(np.bincount(y[learn], minlength=len(classes)) + 1.0).astype(np.float32)
    b -= b.mean()
    seen_e, seen_w, seen_b = np.full_like(e, 1e-8), np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(epochs):
        rng.shuffle(learn)
        for k in range(0, len(learn), batch):
            part = learn[k : k + batch]
            x = np.zeros((len(part), features.size), np.float32)
            for j, i in enumerate(part):
                at, n = rows[i]
                x[j, at] = n / max(n.sum(), 1)
            h = x @ e
            g = softmax(h @ w + b)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            for value, seen, grad in ((e, seen_e, x.T @ (g @ w.T)), (w, seen_w, h.T @ g), (b, seen_b, g.sum(0))):
                seen += grad * grad
                value -= rate * grad / np.sqrt(seen)
    model = Model(features, classes, (e @ w).astype(np.float64), b.astype(np.float64))
    held = held if len(held) else learn
    logits = model.logits([texts[i] for i in held])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.5, 8, 41), key=loss))
    share = (np.bincount(y[held], minlength=len(classes)) + 1) / (len(held) + len(classes))
    shift = np.zeros(len(classes))
    for _ in range(20):  # until the mean probabilities are the classes' shares
        shift += np.log(share / softmax(logits / temperature + shift).mean(0))
    p = softmax(logits / temperature + shift)
    right = p.argmax(1) == y[held]
    limit = float(np.quantile(p.max(1)[right], reject_share)) if right.any() else 0.0
    return Model(features, classes, model.table, model.bias + temperature * shift, temperature, min(limit, 0.5))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without text, with ``__probs``: a probability for each class of the model, if any; a null text is as an empty one."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in keep]
    if not model.classes:
        return docs.select(*names, F.array().cast("array<double>").alias("__probs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probabilities(batch.column("text").to_pylist())
            probs = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64())) if len(p) else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], probs], names=[*names, "__probs"])

    return in_batches(docs.select(*names, "text")).mapInArrow(run, T.StructType([*keep, T.StructField("__probs", T.ArrayType(T.DoubleType()))]))
