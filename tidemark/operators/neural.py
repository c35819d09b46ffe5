"""The relational side of the sequence model, and its forward pass for given weights.

Training is not done here. Weights come from outside as numpy arrays; users are encoded in
parallel in Arrow batches, and the vectors go to ranking as any others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import write_vectors
from ..sources.work import materialise
from . import metrics
from .ranking import rank_blocks
from .sequences import tail
from .skew import salted_join
from .splits import md5_order

MIN_Q = 1e-9


def log_q(popularity: DataFrame, least: float = MIN_Q) -> DataFrame:
    """(dense_id, log_q): log of each item's share of all rows, at least ``least``; no rows at all is an error."""
    total = popularity.agg(F.sum("popularity")).first()[0] or 0
    if total <= 0:
        raise ValueError("popularity must sum to more than 0")
    return popularity.select("dense_id", F.log(F.greatest(F.col("popularity") / float(total), F.lit(least))).alias("log_q"))


def capped_positions(positions: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows (uid, pos, ...) by random order; all if ``most`` is 0."""
    if most <= 0:
        return positions
    return positions.withColumn("__key", md5_order(seed, "uid", "pos")).orderBy("__key", "uid", "pos").limit(most).drop("__key")


@dataclass(frozen=True)
class Layer:
    """One encoder layer: x @ weight.T + bias throughout; normalisation comes after each sum."""

    in_weight: np.ndarray  # (3d, d): query, key, value
    in_bias: np.ndarray
    out_weight: np.ndarray
    out_bias: np.ndarray
    up_weight: np.ndarray
    up_bias: np.ndarray
    down_weight: np.ndarray
    down_bias: np.ndarray
    norm1: tuple[np.ndarray, np.ndarray]
    norm2: tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Encoder:
    """What an encoder has beside its item vectors, which stay in a frame (dense_id, vec)."""

    positions: np.ndarray  # (max_len, d), newest first
    norm: tuple[np.ndarray, np.ndarray]
    layers: tuple[Layer, ...]
    heads: int
    eps: float = 1e-9


def content_items(audio: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Item vectors from frozen ones: a linear map, then length 1 (a zero vector stays)."""
    x = audio @ weight.T + bias
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def content_vectors(items: DataFrame, weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(dense_id, vec) of a frame (dense_id, vec): content_items() block by block."""
    dim = weight.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, weight.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("dense_id"), _lists(content_items(x, weight, bias), dim)], names=["dense_id", "vec"])

    return items.select("dense_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "dense_id long, vec array<double>")


def _lists(x: np.ndarray, dim: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float64()))


def _norm(x: np.ndarray, p: tuple[np.ndarray, np.ndarray], eps: float) -> np.ndarray:
    m = x.mean(-1, keepdims=True)
    return (x - m) / np.sqrt(((x - m) ** 2).mean(-1, keepdims=True) + eps) * p[0] + p[1]


def erf(x: np.ndarray) -> np.ndarray:
    """The error function by a published polynomial of degree five; its error is under 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def hidden_states(model: Encoder, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hidden states (users, longest, d) of left-aligned sequences of item vectors.

    Each state depends only on the items up to its own, so what fills a row beyond its length
    has no effect on the states before.
    """
    users, n, d = x.shape
    back = np.maximum(lengths[:, None] - 1 - np.arange(n), 0)
    x = _norm(x + model.positions[back], model.norm, model.eps)
    later = np.triu(np.ones((n, n), bool), 1)
    for layer in model.layers:
        q, k, v = (x @ layer.in_weight.T + layer.in_bias).reshape(users, n, 3, model.heads, d // model.heads).transpose(2, 0, 3, 1, 4)
        a = q @ k.transpose(0, 1, 3, 2) / math.sqrt(d // model.heads)
        a[..., later] = -np.inf
        a = np.exp(a - a.max(-1, keepdims=True))
        a = (a / a.sum(-1, keepdims=True)) @ v
        x = _norm(x + a.transpose(0, 2, 1, 3).reshape(users, n, d) @ layer.out_weight.T + layer.out_bias, layer.norm1, model.eps)
        up = x @ layer.up_weight.T + layer.up_bias
        up = up * 0.5 * (1 + erf(up / math.sqrt(2)))
        x = _norm(x + up @ layer.down_weight.T + layer.down_bias, layer.norm2, model.eps)
    return x


def _located(seqs: DataFrame, items: DataFrame, longest: int) -> DataFrame:
    """(uid, n, ids, x): each user's last items and their vectors, one after the other."""
    at = seqs.select("uid", F.posexplode_outer(tail(F.col("items"), longest)).alias("pos", "dense_id"))
    vec = F.when(F.col("dense_id").isNull() | F.col("vec").isNotNull(), F.col("vec").cast("array<double>")).otherwise(F.raise_error(F.lit("an item has no vector")).cast("array<double>"))
    rows = at.join(items.select("dense_id", "vec"), "dense_id", "left").select("uid", "pos", "dense_id", vec.alias("vec"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "dense_id", "vec"))))  # at most max_len items
    return rows.groupBy("uid").agg(ordered.alias("s")).select("uid", F.size("s").alias("n"), F.transform("s", lambda x: x["dense_id"]).alias("ids"), F.flatten(F.transform("s", lambda x: x["vec"])).alias("x"))


def _states(model: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a batch of _located(), their hidden states), by blocks of like length; rows without items are left out."""
    d = len(model.norm[0])
    n, flat = batch.column("n").to_numpy(), batch.column("x").flatten().to_numpy().reshape(-1, d)
    first = np.concatenate([[0], np.cumsum(n)])
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    for low in range(0, len(order), 64):
        part = order[low : low + 64]
        x = np.zeros((len(part), n[part[-1]], d))
        for j, i in enumerate(part):
            x[j, : n[i]] = flat[first[i] : first[i + 1]]
        yield part, hidden_states(model, x, n[part])


def user_vectors(seqs: DataFrame, items: DataFrame, model: Encoder) -> DataFrame:
    """(uid, vec): the last hidden state of each user's sequence (uid, items), zeros for an empty one.

    ``items`` is (dense_id, vec). The last max_len items of each user meet their vectors by a
    join, so no task holds the whole item table; users are encoded by blocks of like length. An
    item without a vector fails the job that reads the result.
    """
    longest, d = len(model.positions), len(model.norm[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = batch.column("n").to_numpy(), np.zeros((batch.num_rows, d))
            for part, states in _states(model, batch):
                out[part] = states[np.arange(len(part)), n[part] - 1]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), _lists(out, d)], names=["uid", "vec"])

    return _located(seqs, items, longest).select("uid", "n", "x").mapInArrow(run, "uid long, vec array<double>")


def position_states(seqs: DataFrame, items: DataFrame, model: Encoder) -> DataFrame:
    """(uid, pos, dense_id, vec): the hidden state at every position of each user's last items, from 0."""
    longest, d = len(model.positions), len(model.norm[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = batch.column("n").to_numpy(), batch.column("ids")
            for part, states in _states(model, batch):
                size = n[part]
                flat = np.concatenate([s[:k] for s, k in zip(states, size, strict=True)])
                pos = np.concatenate([np.arange(k) for k in size])
                rows = pa.array(np.repeat(part, size))
                yield pa.RecordBatch.from_arrays([batch.column("uid").take(rows), pa.array(pos), ids.take(pa.array(part)).flatten(), _lists(flat, d)], names=["uid", "pos", "dense_id", "vec"])

    return _located(seqs, items, longest).mapInArrow(run, "uid long, pos long, dense_id long, vec array<double>")


def evaluate(seqs: DataFrame, items: DataFrame, model: Encoder, targets: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(metrics, per user): encode users, rank all items for each, and score against ``targets`` (uid, item_id as dense ids).

    Only users with targets are encoded, once: their vectors and their ranking are written out.
    """
    wanted = targets.select("uid").distinct()
    vectors = materialise(user_vectors(seqs.join(wanted, "uid", "left_semi"), items, model))
    k = max(k for _, k in metrics.parse(names))
    ranked = materialise(rank_blocks(vectors, items.withColumnRenamed("dense_id", "item_id"), k))
    plain = [n for n in names if not n.startswith("coverage")]
    return metrics.evaluate(ranked, targets, items.count(), names), metrics.per_user(ranked, targets, plain)


def extract(seqs: Mapping[str, DataFrame], items: DataFrame, model: Encoder, path: str) -> None:
    """Write the item vectors, and for each split the user vectors and ids, as tables under ``path``."""
    write_vectors({"items": items} | {name: user_vectors(s, items, model) for name, s in seqs.items()}, path)


def softmax_losses(queries: np.ndarray, users: np.ndarray, positives: np.ndarray, log_q: np.ndarray, uniform: np.ndarray, n_items: int, log_tau: float) -> np.ndarray:
    """The loss of each row of a batch: its positive's vector against other users' positives and uniform negatives.

    In-batch logits lose log q and those of the same user are left out, uniform ones lose log 1/n,
    the positive is not corrected; the temperature is held within [0.01, 100].
    """
    tau = min(max(math.exp(log_tau), 0.01), 100.0)
    own = (queries * positives).sum(1) / tau
    batch = queries @ positives.T / tau - log_q[None]
    batch[users[:, None] == users[None]] = -np.inf
    drawn = queries @ uniform.T / tau + math.log(n_items)
    x = np.concatenate([own[:, None], batch, drawn], 1)
    top = x.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(x - top).sum(1)) - own


def sampled_softmax(queries: np.ndarray, users: np.ndarray, positives: np.ndarray, items: np.ndarray, log_q_items: np.ndarray, uniform: np.ndarray, log_tau: float) -> float:
    """The mean loss of one batch, positives and uniform negatives given by their rows in ``items``."""
    return float(softmax_losses(queries, users, items[positives], log_q_items[positives], items[uniform], len(items), log_tau).mean())


def batch_losses(positions: DataFrame, items: DataFrame, log_q: DataFrame, n_items: int, size: int, negatives: int, seed: int, log_tau: float) -> DataFrame:
    """(batch, n, loss): the mean sampled-softmax loss of each batch of ``positions`` (uid, pos, vec, positive).

    Positions are dealt by md5 to batches of about ``size``; a batch draws ``negatives`` dense
    ids below n_items, with replacement. Positives and draws meet their vectors (dense_id, vec) and
    log q by joins, and a batch's matrices are one Arrow group, so no task holds the items.
    An id without a vector or log q fails the job that reads the result.
    """
    batches = max(1, -(-positions.count() // size))
    unit = lambda h: F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)
    known = items.join(log_q, "dense_id", "left").select(F.col("dense_id").alias("positive"), F.col("vec").cast("array<double>").alias("pvec"), "log_q")
    dealt = positions.withColumn("batch", F.floor(unit(md5_order(seed, "uid", "pos")) * batches).cast("long"))
    found = salted_join(dealt, known, ["positive"], "left")
    sound = F.when(F.col("pvec").isNotNull() & F.col("log_q").isNotNull(), F.col("log_q")).otherwise(F.raise_error(F.lit("an item has no vector or log q")).cast("double"))
    found = found.select("batch", "uid", "pos", F.col("vec").cast("array<double>").alias("vec"), "pvec", sound.alias("log_q"))
    draws = dealt.select("batch").distinct().select("batch", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))).alias("draw")) if negatives else dealt.select("batch", F.lit(0).alias("draw")).limit(0)
    drawn = draws.withColumn("dense_id", F.floor(unit(md5_order(f"{seed}:n", "batch", "draw")) * n_items).cast("long"))
    drawn = drawn.join(items.select("dense_id", F.col("vec").cast("array<double>").alias("vec")), "dense_id").select(F.col("batch").alias("of_batch"), "draw", "vec")

    def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0)]).reshape(-1, d)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by([("uid", "ascending"), ("pos", "ascending")]), right.sort_by("draw")
        rows = []
        if left.num_rows:
            d = len(left.column("vec")[0])
            loss = softmax_losses(matrix(left.column("vec"), d), left.column("uid").to_numpy(), matrix(left.column("pvec"), d), left.column("log_q").to_numpy(), matrix(right.column("vec"), d), n_items, log_tau)
            rows.append((left.column("batch")[0].as_py(), len(loss), float(loss.mean())))
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("batch", pa.int64()), ("n", pa.int64()), ("loss", pa.float64())))})

    return found.groupBy("batch").cogroup(drawn.groupBy("of_batch")).applyInArrow(run, "batch long, n long, loss double")
