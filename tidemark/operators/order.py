"""Running totals, ranks and exact percentiles over sorted values, of which no task sees all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.work import materialise


def with_before(rows: DataFrame, keys: Sequence[str], amount: str | None = None) -> DataFrame:
    """``rows`` with before: the rows, or the sum of a column of whole numbers, that sort before each by ``keys``.

    Rows are dealt to tasks by ranges of the keys and written; a range's own running sum is
    added to the sum of the ranges below it. Rows with equal keys follow one another in any order.
    """
    m = F.lit(1).cast("long") if amount is None else F.col(amount)
    placed = materialise(rows.withColumn("__m", m).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    below = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a task
    zero = F.lit(0).cast("long")
    offsets = placed.groupBy("__part").agg(F.sum("__m").alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(below), zero).alias("__offset"))
    within = F.coalesce(F.sum("__m").over(W.partitionBy("__part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), zero)
    return placed.withColumn("__within", within).join(F.broadcast(offsets), "__part").withColumn("before", F.col("__offset") + F.col("__within")).select(*rows.columns, "before")


def value_counts(df: DataFrame, value: str | Column) -> DataFrame:
    """(x, m): how many rows have each value that is not null, as a double."""
    x = F.col(value) if isinstance(value, str) else value
    return df.select(x.cast("double").alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("m"))


def percentiles(df: DataFrame, value: str | Column, shares: Sequence[float]) -> DataFrame:
    """One row (p): exact percentiles, linearly interpolated, as an array; nulls if there is no value."""
    at = with_before(value_counts(df, value), ["x"], "m")
    total = at.agg(F.sum("m").alias("n"))
    place = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    pick = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("m")), F.col("x")))
    ends = [(pick(F.floor(h)), pick(F.ceil(h)), F.max(h - F.floor(h))) for h in place]
    return at.join(F.broadcast(total), how="cross").agg(F.array(*[low + part * (high - low) for low, high, part in ends]).alias("p"))  # total has one row
