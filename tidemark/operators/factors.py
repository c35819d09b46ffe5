"""Implicit-feedback factors by alternating least squares, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import Scratch, materialise
from .skew import hot_keys, salted_join
from .splits import md5_order

#: Confidence of a pair seen n times is 1 + ALPHA * n.
ALPHA, PENALTY, ROUNDS, SEED = 10.0, 0.1, 3, 42


def start(ids: DataFrame, rank: int, seed: int) -> DataFrame:
    """(id, vec): numbers in [0, 1) / rank from md5, the same on any engine."""
    part = lambda j: F.conv(F.substring(md5_order(f"{seed}:{j}", "id"), 1, 12), 16, 10).cast("double") / float(1 << 48) / rank
    return ids.select("id", F.array(*[part(j) for j in range(rank)]).alias("vec"))


def gramian(factors: DataFrame, rank: int) -> np.ndarray:
    """The sum of the outer products of all vectors: rank * rank numbers."""
    v = F.col("vec")
    row = factors.agg(*[F.coalesce(F.sum(v[i] * v[j]), F.lit(0.0)) for i in range(rank) for j in range(rank)]).first()
    return np.array(row, np.float64).reshape(rank, rank)


def solved(pairs: DataFrame, mine: str, other: str, factors: DataFrame, rank: int, alpha: float, penalty: float, hot: DataFrame | None = None, hot_mine: DataFrame | None = None) -> DataFrame:
    """(id, vec, seen): for each ``mine`` of ``pairs`` (uid, item_id, n) the least-squares vector, given those of the ``other`` side.

    The unseen pairs come in by the Gramian, the same for all. What a pair adds to its id's
    equations are sums of products. Vectors move to the ids and are multiplied there, as products
    are larger than vectors; for the ids with very many pairs, ``hot_mine`` (id), the sums are
    added up by tasks before they move, so a heavy id is never gathered. The small systems are
    solved in batches. The same sums give ``seen``, what the id's pairs add to the objective: the
    sum of c (1 - s)^2 - s^2 over them, s = x . v, is sum(c) - 2 x . b + x' a x. ``hot`` names
    the ids (id) of the other side with very many pairs.
    """
    shared = gramian(factors, rank) + penalty * np.eye(rank)
    joined = salted_join(pairs.select(F.col(mine).alias("__id"), F.col(other).alias("id"), (F.col("n") * alpha).alias("c")), factors.select("id", "vec"), ["id"], hot=hot)
    v, upper = F.col("vec"), [(i, j) for i in range(rank) for j in range(i, rank)]
    joined = joined.select("__id", "c", "vec")
    added = lambda rows: rows.groupBy("__id").agg(F.array(*[F.sum(F.col("c") * v[i] * v[j]) for i, j in upper]).alias("a"), F.array(*[F.sum((F.col("c") + 1) * v[i]) for i in range(rank)]).alias("b"), F.sum(F.col("c") + 1).alias("w"))
    if hot_mine is None or hot_mine.isEmpty():
        sums = added(joined.repartition("__id"))
    else:
        heavy = F.broadcast(hot_mine.select(F.col("id").alias("__id")))
        sums = added(joined.join(heavy, "__id", "left_anti").repartition("__id")).unionByName(added(joined.join(heavy, "__id", "left_semi")))
    rows, columns = np.array(upper).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.zeros((batch.num_rows, rank, rank))
            a[:, rows, columns] = batch.column("a").flatten().to_numpy().reshape(-1, len(upper))
            a[:, columns, rows] = a[:, rows, columns]
            b = batch.column("b").flatten().to_numpy().reshape(-1, rank, 1)
            x = np.linalg.solve(a + shared, b)
            seen = batch.column("w").to_numpy() + (x.transpose(0, 2, 1) @ (a @ x - 2 * b))[:, 0, 0]
            vec = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), rank).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), vec, pa.array(seen)], names=["id", "vec", "seen"])

    return sums.mapInArrow(run, "id long, vec array<double>, seen double")


def objective(pairs: DataFrame, users: DataFrame, items: DataFrame, rank: int, alpha: float, penalty: float) -> float:
    """The weighted squared error over all pairs, seen or not, and the penalty.

    Unseen pairs add the square of their score: all squares come from the two Gramians, and
    the seen ones are put right.
    """
    both = salted_join(salted_join(pairs, users.select(F.col("id").alias("uid"), F.col("vec").alias("u")), ["uid"]), items.select(F.col("id").alias("item_id"), F.col("vec").alias("i")), ["item_id"])
    score = sum((F.col("u")[j] * F.col("i")[j] for j in range(rank)), F.lit(0.0))
    seen = both.select((1 + F.col("n") * alpha).alias("c"), score.alias("s")).agg(F.coalesce(F.sum(F.col("c") * (1 - F.col("s")) ** 2 - F.col("s") ** 2), F.lit(0.0))).first()[0]
    return _with_unseen(seen, users, items, rank, penalty)


def _with_unseen(seen: float, users: DataFrame, items: DataFrame, rank: int, penalty: float) -> float:
    gu, gi = gramian(users, rank), gramian(items, rank)
    return float(seen + (gu * gi).sum() + penalty * (np.trace(gu) + np.trace(gi)))


def factorise(log: DataFrame, rank: int, rounds: int = ROUNDS, alpha: float = ALPHA, penalty: float = PENALTY, seed: int = SEED) -> tuple[DataFrame, DataFrame, list[float]]:
    """(users, items, objective after each round): vectors (id, vec) of all users and items of ``log`` (uid, item_id).

    n counts a pair's rows. A round solves all users, then all items; each table is written and
    those of the round before are deleted. The objective needs no join of its own, see solved().
    """
    pairs = materialise(log.filter("uid IS NOT NULL AND item_id IS NOT NULL").groupBy("uid", "item_id").agg(F.count(F.lit(1)).alias("n")))
    hot_users, hot_items = (hot_keys(pairs.select(F.col(c).alias("id")), ["id"]) for c in ("uid", "item_id"))
    costs: list[float] = []
    items = materialise(start(pairs.select(F.col("item_id").alias("id")).distinct(), rank, seed))
    for turn in range(rounds):
        with Scratch(log.sparkSession) as tables:
            last = turn + 1 == rounds
            users = (materialise if last else tables.store)(solved(pairs, "uid", "item_id", items, rank, alpha, penalty, hot_items, hot_users))
            items = materialise(solved(pairs, "item_id", "uid", users, rank, alpha, penalty, hot_users, hot_items))
            seen = items.agg(F.coalesce(F.sum("seen"), F.lit(0.0))).first()[0]
            costs.append(_with_unseen(seen, users, items, rank, penalty))
    return users.drop("seen"), items.drop("seen"), costs
