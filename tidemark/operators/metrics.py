"""Ranking metrics: columns over a user's hits, averaged over users with targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import percentiles
from .ranking import hits


def _first(k: int) -> Column:
    return F.col("rank") <= k


def _sum_hits(k: int) -> Column:
    return F.sum(F.when(_first(k), F.col("hit")).otherwise(0))


def _wanted(k: int) -> Column:
    return F.least(F.when(F.max("n_targets") > 0, F.max("n_targets")).otherwise(k), F.lit(k))


def _gain(position: Column) -> Column:
    return 1 / F.log2(position + 1)


def _dcg(k: int) -> Column:
    return F.sum(F.when(_first(k), F.col("hit") * _gain(F.col("rank"))).otherwise(0.0))


def _ndcg(k: int) -> Column:
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.max("n_targets"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + _gain(i))
    return F.when(F.max("n_targets") > 0, _dcg(k) / ideal).otherwise(0.0)


#: A user's metric by name: k -> an aggregate over the user's rows (rank, hit, n_targets).
METRICS: dict[str, Callable[[int], Column]] = {
    "recall": lambda k: _sum_hits(k) / _wanted(k),
    "precision": lambda k: _sum_hits(k) / F.lit(k),
    "hitrate": lambda k: (_sum_hits(k) > 0).cast("double"),
    "mrr": lambda k: F.coalesce(1 / F.min(F.when(_first(k) & (F.col("hit") == 1), F.col("rank"))), F.lit(0.0)),
    "dcg": _dcg,
    "ndcg": _ndcg,
}


def parse(names: Sequence[str]) -> list[tuple[str, int]]:
    """name@k pairs, without repeats, in order; an unknown name is a KeyError."""
    out = set()
    for name in names:
        base, _, k = name.partition("@")
        if base not in METRICS and base != "coverage":
            raise KeyError(base)
        out.add((base, int(k)))
    return sorted(out)


def per_user(ranked: DataFrame, targets: DataFrame, names: Sequence[str]) -> DataFrame:
    """(uid, a column for each name@k as name_k) of users with targets, in one pass over their hits.

    Every user with targets needs a ranking that reaches the largest k; one who lacks it fails
    the job that reads the result.
    """
    wanted = [(m, k) for m, k in parse(names) if m != "coverage"]
    if bad := [k for _, k in wanted if k <= 0]:
        raise ValueError(f"cut-offs {bad}")
    n = targets.select("uid", "item_id").distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("n_targets"))
    rows = n.join(hits(ranked, targets), "uid", "left").groupBy("uid").agg(*[METRICS[m](k).cast("double").alias(f"{m}_{k}") for m, k in wanted], F.max("rank").alias("__reach"))
    most = max(k for _, k in wanted)
    short = F.when(F.col("__reach").isNull(), "a user with targets has no ranking").when(F.col("__reach") < most, f"cut-off {most} is beyond a user's ranking")
    sound = lambda c: F.when(short.isNull(), F.col(c)).otherwise(F.raise_error(short).cast("double")).alias(c)
    return rows.select("uid", *[sound(f"{m}_{k}") for m, k in wanted])


def coverage(ranked: DataFrame, ks: Sequence[int], n_items: int) -> DataFrame:
    """(k, value): distinct items in the top k of all ranked users over the catalogue's size, for each k in one pass."""
    best = ranked.groupBy("item_id").agg(F.min("rank").alias("best"))
    counts = best.agg(*[(F.count_if(F.col("best") <= k) / F.lit(n_items)).alias(f"c{k}") for k in ks])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("value")) for k in ks])).alias("x")).select("x.*")


def evaluate(ranked: DataFrame, targets: DataFrame, n_items: int, names: Sequence[str]) -> DataFrame:
    """(metric, k, value): means over users with targets; coverage over all ranked users.

    The ranking is read twice, by user and by item: store one that is dear to compute.
    """
    wanted = parse(names)
    plain, covered = [(m, k) for m, k in wanted if m != "coverage"], [k for m, k in wanted if m == "coverage"]
    out = None
    if plain:
        means = per_user(ranked, targets, [f"{m}@{k}" for m, k in plain]).agg(*[F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m, k in plain])
        out = means.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"{m}_{k}").alias("value")) for m, k in plain])).alias("x")).select("x.*")
    if covered:
        rows = coverage(ranked, covered, n_items).select(F.lit("coverage").alias("metric"), "k", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def user_percentiles(users: DataFrame, column: str) -> DataFrame:
    return percentiles(users, column, (0.1, 0.5, 0.9)).select(*[F.col("p")[i].alias(f"p{x}") for i, x in enumerate((10, 50, 90))])
