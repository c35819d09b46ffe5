"""Paired significance tests and bootstrap intervals over per-user metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import with_before


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """One row (n, w, p): the two-sided signed-rank test over pairs (a, b).

    Zero differences are dropped; without any other, w is 0 and p 1. Tied differences share
    their mean rank. p is the normal approximation with tie correction. Ranks come from counts
    of equal differences, so rows are never sorted in one task.
    """
    d = pairs.select((F.col("a") - F.col("b")).alias("d")).filter("d <> 0")
    same = d.groupBy(F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = with_before(same, ["size"], "m").withColumn("rank", F.col("before") + (F.col("m") + 1) / 2)
    n, up, all_ranks, ties = ranked.agg(F.sum("m"), F.sum(F.col("rank") * F.col("up")), F.sum(F.col("rank") * F.col("m")), F.sum(F.col("m") * (F.col("m") * F.col("m") - 1).cast("double"))).first()
    if not n:
        return pairs.sparkSession.createDataFrame([(0, 0.0, 1.0)], "n long, w double, p double")
    w = min(float(up), float(all_ranks) - float(up))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    p = math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)) if var > 0 else 1.0
    return pairs.sparkSession.createDataFrame([(int(n), w, min(1.0, p))], "n long, w double, p double")


def bonferroni(tests: DataFrame, alpha: float = 0.05, n: int | None = None) -> DataFrame:
    """``tests`` (with p) and whether each is significant at alpha over the number of tests."""
    m = n if n is not None else tests.count()
    return tests.withColumn("significant", F.col("p") < alpha / max(m, 1))


def bootstrap_mean(values: DataFrame, draws: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row (mean, low, high): the percentile interval of the mean over ``draws`` resamples of x.

    ``values`` is (id, x). Each resample takes n rows at positions hashed from seed, resample
    and draw, so runs agree; n * draws positions are made, without values, and meet them by a join.
    """
    n = values.count()
    if not n:
        raise ValueError("no values to resample")
    at = with_before(values, ["id"]).withColumnRenamed("before", "pos")
    spots = values.sparkSession.range(draws * n).select(F.expr(f"id div {n}").alias("resample"), F.col("id").alias("draw"))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string")).cast("binary"))
    spots = spots.select("resample", F.floor(F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / float(1 << 48) * n).cast("long").alias("pos"))
    means = spots.groupBy("resample", "pos").count().join(at.select("pos", "x"), "pos").groupBy("resample").agg((F.sum(F.col("x") * F.col("count")) / n).alias("m"))
    tail = (1 - level) / 2
    p = F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail)))  # of as many means as draws
    return means.agg(p.alias("p")).crossJoin(values.agg(F.avg("x").alias("mean"))).select("mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def seed_averaged(users: DataFrame, columns: list[str]) -> DataFrame:
    """Per model and user, the mean over seeds of each metric: what a paired test compares."""
    return users.groupBy("model", "uid").agg(*[F.avg(c).alias(c) for c in columns])


def by_history(users: DataFrame, lengths: DataFrame, column: str, parts: int = 4) -> DataFrame:
    """(segment, users, value): mean metric by quarter of history length, ties by uid.

    Users are numbered in order of (length, uid), by ranges of it.
    """
    rows = users.select("uid", F.col(column).alias("value")).join(lengths.select("uid", "length"), "uid")
    at = with_before(rows, ["length", "uid"]).withColumnRenamed("before", "i").join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))), how="cross")  # one row
    big, size = F.col("n") % parts, F.expr(f"n div {parts}")
    edge = big * (size + 1)
    segment = F.when(F.col("i") < edge, F.floor(F.col("i") / (size + 1))).otherwise(big + F.floor((F.col("i") - edge) / F.greatest(size, F.lit(1)))) + 1
    return at.groupBy(segment.cast("int").alias("segment")).agg(F.count(F.lit(1)).alias("users"), F.avg("value").alias("value"))
