"""Joins that a hot key does not bring to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import materialise

#: Tasks that share the rows of one key.
SALTS = 16
#: Rows of a key that is hot, about, and the share of all rows that are counted to find such keys.
HOT, COUNTED = 100_000, 0.01


def hot_keys(rows: DataFrame, keys: Sequence[str], hot: int = HOT, counted: float = COUNTED) -> DataFrame:
    """The ``keys`` of about ``hot`` rows or more, for salted_join(): at most one for so many rows.

    Some of the rows are counted, which only decides where rows go, not what is joined. A key
    of twice as many rows is as good as never missed.
    """
    some = rows.select(*keys).dropna()
    some = some.sample(counted, 1) if counted < 1 else some
    return materialise(some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot * counted).select(*keys))


def salted_join(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``small`` on ``keys``, each key's rows dealt to so many tasks.

    ``small`` is repeated for each of them, so it should have few rows a key; ``rows`` may have
    any number. Their other columns decide where they go. how is inner or left. Null keys meet nothing.
    Where ``hot`` is given (see hot_keys()), only its keys are dealt and repeated, so that
    ``small`` may be large.
    """
    if hot is not None and how == "inner" and hot.isEmpty():
        return rows.join(small, list(keys), how)
    others = [c for c in rows.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*others), F.lit(salts)) if others else F.lit(0).cast("long")
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    if hot is not None:
        mark = F.broadcast(hot.select(*keys).withColumn("__hot", F.lit(True)))
        unmatched = F.lit(False)
        for key in keys:
            unmatched = unmatched | F.col(key).isNull()
        rows, small = rows.join(mark, list(keys), "left"), small.join(mark, list(keys), "left")
        salt = F.when(F.col("__hot") | unmatched, salt).otherwise(F.lit(0).cast("long"))
        every = F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0).cast("long")))
    dealt = rows.withColumn("__salt", salt).drop("__hot")
    return dealt.join(small.withColumn("__salt", F.explode(every)).drop("__hot"), [*keys, "__salt"], how).drop("__salt")
