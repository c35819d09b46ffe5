"""Cleaning an interaction log: coverage, duplicates, thresholds and iterated minimum counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.work import Scratch, discard, hand_over, stored
from .order import percentiles

KEY = ("uid", "timestamp", "item_id")
#: Ids that every task may hold.
FEW = 200_000


def covered(log: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose item is among the ids of ``known``."""
    return log.join(known.select("item_id").distinct(), "item_id", "left_semi").select(*log.columns)


def keep_users(log: DataFrame, users: DataFrame) -> DataFrame:
    return log.join(users.select("uid").distinct(), "uid", "left_semi").select(*log.columns)


def loss_by_user(before: DataFrame, after: DataFrame) -> DataFrame:
    """(uid, n_before, n_after, loss): what each user lost; a user with nothing left has n_after 0."""
    b = before.groupBy("uid").agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy("uid").agg(F.count(F.lit(1)).alias("n_after"))
    out = b.join(a, "uid", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0).cast("long")))
    return out.withColumn("loss", 1 - F.col("n_after") / F.col("n_before"))


def loss_profile(losses: DataFrame, heavy: float = 0.80) -> DataFrame:
    """One row: users, those fully lost, survivors who lost ``heavy`` or more, and percentiles of survivors' loss."""
    survivor = F.col("n_after") > 0
    p = percentiles(losses.filter(survivor), "loss", (0.25, 0.5, 0.75, 0.95)).select(*[F.col("p")[i].alias(f"loss_p{x}") for i, x in enumerate((25, 50, 75, 95))])
    counts = losses.agg(F.count(F.lit(1)).alias("users"), F.count_if(~survivor).alias("fully_lost"), F.count_if(survivor & (F.col("loss") >= heavy)).alias("heavy_loss"))
    return counts.join(p, how="cross")  # one row each


def exact_dedup(log: DataFrame) -> DataFrame:
    return log.distinct()


def collisions(log: DataFrame) -> DataFrame:
    """(uid, timestamp, item_id, count) of keys that more than one row has."""
    return log.groupBy(*KEY).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def unique_keys(log: DataFrame) -> DataFrame:
    """One row (ok): whether no key has more than one row. Rows are sorted by key, which may spill; no task holds a table of its keys beside."""
    same = F.count(F.lit(1)).over(W.partitionBy(*KEY))
    return log.select(*KEY, same.alias("__n")).agg((F.count_if(F.col("__n") > 1) == 0).alias("ok"))


def key_dedup(log: DataFrame) -> DataFrame:
    """One row a key: of most played, then longest track, then organic. A map-side combine keeps hot keys small."""
    rest = ("played_ratio_pct", "track_length_seconds", "is_organic")
    best = log.groupBy(*KEY).agg(F.max(F.struct(*rest)).alias("best"))
    return best.select(*KEY, *[F.col(f"best.{c}") for c in rest]).select(*log.columns)


def played(log: DataFrame, at_least: int) -> DataFrame:
    return log.filter(F.col("played_ratio_pct") >= at_least)


def _without(log: DataFrame, rare: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose value of ``column`` is known and not among the ``n`` of ``rare``; a small set goes to every task, so the log stays where it is."""
    return log.filter(F.col(column).isNotNull()).join(F.broadcast(rare) if n <= FEW else rare, column, "left_anti")


def min_counts(log: DataFrame, min_user: int, min_item: int, max_rounds: int = 20) -> tuple[DataFrame, int]:
    """The largest part of ``log`` in which every user and item has its minimum of rows, and the rounds taken.

    Each round counts users and items of the same snapshot and applies both minimums at once;
    the last round is the one that changes nothing. Rounds are written to the shared folder, so
    lineage stays short and a lost executor costs no more than the round. Only those below
    their minimum are written and looked up: they are few after the first rounds.
    """
    spark = log.sparkSession
    snapshot, path = stored(log)
    for turn in range(1, max_rounds + 1):
        with Scratch(spark) as tables:
            rare = {c: tables.store(snapshot.groupBy(c).count().filter((F.col("count") < least) | F.col(c).isNull()).select(c)) for c, least in (("uid", min_user), ("item_id", min_item))}
            counts = {c: df.count() for c, df in rare.items()}
            if not any(counts.values()):
                hand_over(spark, path)
                return snapshot, turn
            after = snapshot
            for c, df in rare.items():
                after = _without(after, df.filter(F.col(c).isNotNull()), c, counts[c])
            after, after_path = stored(after.select(*log.columns))
        discard(spark, path)
        snapshot, path = after, after_path
    raise RuntimeError(f"minimum counts did not settle in {max_rounds} rounds")


def clean(log: DataFrame, min_played: int, min_user: int, min_item: int, max_rounds: int = 20) -> DataFrame:
    """What exact duplicates, key collisions, played share and minimum counts leave, in this order.

    The key's best row is the same with and without its exact duplicates, and is the most played,
    so the played share may go first and one grouping by key does both.
    """
    return min_counts(key_dedup(played(log, min_played)), min_user, min_item, max_rounds)[0]


def derived_ratio(after: Column, before: Column) -> Column:
    return 1 - after / F.nullif(before, F.lit(0))

