"""Statistics of an interaction log: counts, percentiles, concentration, weekly series, groups of users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import WEEK
from .order import value_counts, with_before
from .splits import Cutoffs, with_split


def percentiles(value: str | Column, shares: Sequence[float]) -> Column:
    """Exact percentiles, linearly interpolated, as an array."""
    return F.percentile(value, F.array(*[F.lit(x) for x in shares]))


def counts(log: DataFrame) -> DataFrame:
    """One row: rows, distinct users, distinct items."""
    return log.agg(F.count(F.lit(1)).alias("rows")).join(distinct_counts(log), how="cross")  # one row each


def distinct_counts(log: DataFrame) -> DataFrame:
    """One row: distinct users and items, each counted by itself: two in one aggregate would double every row."""
    of = lambda column, name: log.select(column).distinct().agg(F.count(column).alias(name))
    return of("uid", "users").join(of("item_id", "items"), how="cross")


def group_counts(log: DataFrame, column: str) -> DataFrame:
    return log.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def histories(log: DataFrame) -> DataFrame:
    """(uid, length, unique_items, diversity) of each user."""
    out = log.groupBy("uid").agg(F.count(F.lit(1)).alias("length"), F.count_distinct("item_id").alias("unique_items"))
    return out.withColumn("diversity", F.col("unique_items") / F.col("length"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, median, min, max and percentiles of a column."""
    out = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"), percentiles(column, (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)).alias("p"))
    return out.select("n", "mean", "min", "max", *[F.col("p")[i].alias(f"p{x}") for i, x in enumerate((25, 50, 75, 90, 95, 99))])


def user_groups(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """``df`` with group: short below ``low``, long from ``high``, medium between."""
    return df.withColumn("group", F.when(F.col(column) < low, "short").when(F.col(column) < high, "medium").otherwise("long"))


def group_bounds(df: DataFrame, column: str, least: int) -> tuple[int, int]:
    """Bounds at the quartiles or, if a group would have under ``least`` rows, at the tertiles; else an error."""
    for shares in ((0.25, 0.75), (1 / 3, 2 / 3)):
        low, high = df.agg(percentiles(column, shares).alias("p")).select(F.bround(F.col("p")[0]).cast("long"), F.bround(F.col("p")[1]).cast("long")).first()
        sizes = {r[0]: r[1] for r in user_groups(df, column, low, high).groupBy("group").count().collect()}
        if min(sizes.get(g, 0) for g in ("short", "medium", "long")) >= least:
            return low, high
    raise ValueError(f"no bounds give three groups of {least}")


def same_magnitude(ours: float, published: float) -> bool:
    return published > 0 and 0.1 <= ours / published <= 10


def gini(df: DataFrame, column: str) -> DataFrame:
    """One row: 2 * sum(rank * x) / (n * sum(x)) - (n + 1) / n over ascending ranks; 0 if there is nothing."""
    values = with_before(value_counts(df, column), ["x"], "m")
    # m equal values x at ranks b+1..b+m: their ranks sum to m * b + m * (m + 1) / 2.
    weighted = F.sum(F.col("x") * (F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2))
    out = values.agg(weighted.alias("w"), F.sum("m").alias("n"), F.sum(F.col("x") * F.col("m")).alias("s"))
    value = 2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return out.select(F.when(F.col("s") != 0, value).otherwise(0.0).alias("gini"))


def head_share(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """One row: the share of the column's sum that its top max(1, ceil(fraction * n)) rows have."""
    values = with_before(value_counts(df, column), ["x"], "m")
    total = values.agg(F.sum("m").alias("n"))
    above = F.col("n") - F.col("before") - F.col("m")
    taken = F.greatest(F.lit(0), F.least(F.col("m"), F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("n"))) - above))
    return values.join(F.broadcast(total), how="cross").agg(F.try_divide(F.sum(F.col("x") * taken), F.sum(F.col("x") * F.col("m"))).alias("head_share"))  # total has one row


def time_range(log: DataFrame) -> DataFrame:
    return log.agg(F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"))


def with_week(log: DataFrame) -> DataFrame:
    """``log`` with week, counted from the first row."""
    low = log.agg(F.min("timestamp")).first()[0] or 0
    return log.withColumn("week", F.expr(f"(timestamp - {low}) div {WEEK}"))


def organic_share(log: DataFrame) -> DataFrame:
    """One row: the share of rows that no recommendation led to."""
    return log.agg(F.avg((F.col("is_organic") == 1).cast("int")).alias("organic_share"))


def weekly(log: DataFrame) -> DataFrame:
    """(week, interactions, active_users), weeks counted from the first row; weeks without rows are absent."""
    return with_week(log).groupBy("week").agg(F.count(F.lit(1)).alias("interactions"), F.count_distinct("uid").alias("active_users"))


def trend(weeks: DataFrame, column: str = "interactions", flat: float = 0.05) -> DataFrame:
    """One row (slope, mean, label): a line through the series by position; flat within ``flat`` of the mean, or under two weeks."""
    at = weeks.withColumn("i", F.row_number().over(W.orderBy("week")) - 1)  # one row a week
    out = at.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(column).cast("double"), F.col("i").cast("double")).alias("slope"), F.avg(column).alias("mean"))
    label = F.when((F.col("n") < 2) | (F.abs("slope") <= flat * F.col("mean")), "flat").when(F.col("slope") > 0, "rising").otherwise("falling")
    return out.select(F.coalesce("slope", F.lit(0.0)).alias("slope"), "mean", label.alias("label"))


def interaction_profile(log: DataFrame) -> DataFrame:
    """One row over the raw log."""
    p = percentiles("played_ratio_pct", (0.25, 0.5, 0.75, 0.95))
    out = log.agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("ts_min"),
        F.max("timestamp").alias("ts_max"), F.avg((F.col("is_organic") == 1).cast("int")).alias("organic_share"), F.avg((F.col("played_ratio_pct") > 100).cast("int")).alias("over_100_share"), p.alias("p"),
    )
    return out.join(distinct_counts(log), how="cross").select("*", *[F.col("p")[i].alias(f"played_p{x}") for i, x in enumerate((25, 50, 75, 95))]).drop("p")


def coverage_counts(log: DataFrame, known: DataFrame) -> DataFrame:
    """One row: items and rows of the log, and how many of either have a vector."""
    items = log.groupBy("item_id").count().join(known.select("item_id").distinct().withColumn("known", F.lit(1)), "item_id", "left")
    return items.agg(
        F.count(F.lit(1)).alias("items"), F.count("known").alias("items_known"), F.sum("count").alias("rows"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("count"))), F.lit(0)).cast("long").alias("rows_known"),
    )


def vector_profile(log: DataFrame, known: DataFrame) -> DataFrame:
    dims = known.agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("vec")).alias("min_dim"), F.max(F.size("vec")).alias("max_dim"))
    return dims.join(coverage_counts(log, known), how="cross")  # one row each


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: distinct values in both, and in each."""
    both = a.select(column, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(column, F.lit(0), F.lit(1))).groupBy(column).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.sum("a").alias("left_values"), F.sum("b").alias("right_values"))


def cutoff_quality(log: DataFrame, cut: Cutoffs) -> DataFrame:
    """(split, rows, users, items, share, rows_per_day, users_in_train, items_in_train) of each split."""
    parts = with_split(log, cut)
    whole = W.partitionBy(F.lit(1))
    base = parts.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("uid").alias("users"), F.count_distinct("item_id").alias("items"), ((F.max("timestamp") - F.min("timestamp")) / 86_400.0 + 1).alias("days"),
    ).withColumn("share", F.col("rows") / F.sum("rows").over(whole)).withColumn("rows_per_day", F.col("rows") / F.col("days"))
    for column, name in (("uid", "users_in_train"), ("item_id", "items_in_train")):
        seen = parts.groupBy(column, "split").agg(F.lit(1).alias("one")).withColumn("trained", F.max((F.col("split") == "train").cast("int")).over(W.partitionBy(column)))
        base = base.join(seen.groupBy("split").agg(F.sum("trained").alias(name)), "split")
    return base.drop("days")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, log_scale: bool = False) -> DataFrame:
    """(bin, count) over equal bins of [low, high], the last one closed; values outside are left out."""
    if log_scale:
        x, a, b = F.log10(F.col(column).cast("double")), F.log10(F.lit(float(low))), F.log10(F.lit(float(high)))
    else:
        x, a, b = F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high))
    at = F.least(F.floor((x - a) / (b - a) * bins), F.lit(bins - 1)).cast("int")
    return df.filter((F.col(column) >= low) & (F.col(column) <= high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def popularity(log: DataFrame, id_map: DataFrame) -> DataFrame:
    """(dense_id, popularity) of every item of the map, zero where the log lacks it."""
    n = log.groupBy(F.col("item_id").alias("raw_id")).agg(F.count(F.lit(1)).alias("popularity"))
    return id_map.join(n, "raw_id", "left").select("dense_id", F.coalesce("popularity", F.lit(0).cast("long")).alias("popularity"))


def check_total(pop: DataFrame, log: DataFrame) -> None:
    have, rows = pop.agg(F.sum("popularity")).first()[0] or 0, log.count()
    if have != rows:
        raise ValueError(f"popularity sums to {have}, the log has {rows} rows")


def over_seeds(runs: DataFrame) -> DataFrame:
    """(model, metric, k, mean, std, n) over runs (model, seed, metric, k, value); one run has deviation 0, missing values are skipped."""
    return runs.filter("value IS NOT NULL").groupBy("model", "metric", "k").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("value").alias("n"))


def seed_table(runs: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row a metric and k, the models' means and deviations side by side."""
    return over_seeds(runs).groupBy("metric", "k").pivot("model", list(models)).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))


def flatten(tree: dict, prefix: str = "") -> dict[str, float]:
    """The numbers of a nested dict by a/b/c keys."""
    out: dict[str, float] = {}
    for k, v in tree.items():
        at = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flatten(v, at + "/")
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out[at] = float(v)
    return out


def drift(now: DataFrame, recorded: dict[str, int]) -> DataFrame:
    """(measure, recorded, found) of each measure of the one-row frame ``now`` that differs from an earlier stage's record."""
    both = F.array(*[F.struct(F.lit(k).alias("measure"), F.lit(int(n)).cast("long").alias("recorded"), F.col(k).cast("long").alias("found")) for k, n in sorted(recorded.items())])
    return now.select(F.explode(both).alias("x")).select("x.*").filter("recorded <> found")


def check_drift(now: DataFrame, recorded: dict[str, int]) -> None:
    if bad := [f"{r.measure}: {r.recorded} recorded, {r.found} found" for r in drift(now, recorded).collect()]:
        raise ValueError("an earlier stage recorded other counts: " + "; ".join(bad))
