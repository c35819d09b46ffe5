"""Checks of a frame against a required schema, and named invariants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_counts(df: DataFrame) -> DataFrame:
    """One row: the nulls of each column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def validate(df: DataFrame, required: T.StructType, origin: str) -> DataFrame:
    """``df`` if it has the required columns, of those types, and no null in any column; extra columns may stand beside."""
    have = {f.name: f.dataType for f in df.schema.fields}
    if missing := [f.name for f in required.fields if f.name not in have]:
        raise ValueError(f"{origin}: missing columns {missing}")
    if wrong := [f"{f.name}: {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in required.fields if have[f.name] != f.dataType]:
        raise ValueError(f"{origin}: wrong types: {'; '.join(wrong)}")
    if nulls := {k: n for k, n in null_counts(df).first().asDict().items() if n}:
        raise ValueError(f"{origin}: nulls in {nulls}")
    return df


def problems(df: DataFrame, required: T.StructType) -> DataFrame:
    """(column, problem, found): each required column that is missing, of another type (found says which) or has nulls (found says how many)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    rows = [(f.name, "missing", "") if f.name not in have else (f.name, "type", have[f.name].simpleString()) for f in required.fields if have.get(f.name) != f.dataType]
    fixed = df.sparkSession.createDataFrame(rows, "column string, problem string, found string")
    present = [f.name for f in required.fields if f.name in have]
    nulls = null_counts(df.select(*present)).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in present])).alias("x"))
    return fixed.unionByName(nulls.filter("x.n > 0").select("x.column", F.lit("nulls").alias("problem"), F.col("x.n").cast("string").alias("found")))


class Invariants:
    """Named checks of how many rows frames have, run together as one job."""

    def __init__(self) -> None:
        self.checks: list[tuple[str, Sequence[DataFrame], int, int]] = []

    def empty(self, name: str, df: DataFrame) -> Invariants:
        """Rows of ``df`` are violations."""
        self.checks.append((name, [df], 0, -1))
        return self

    def at_least(self, name: str, df: DataFrame, least: int = 1) -> Invariants:
        """One violation if ``df`` has fewer rows."""
        self.checks.append((name, [df], least, 1 << 62))
        return self

    def at_most(self, name: str, frames: Sequence[DataFrame], most: int) -> Invariants:
        """One violation if all frames together have more rows."""
        self.checks.append((name, frames, 0, most))
        return self

    def run(self, spark: SparkSession) -> DataFrame:
        """(name, violations) of every check: the rows of all frames, each with its check's number, counted at once."""
        named = spark.createDataFrame([(i, name, least, most) for i, (name, _, least, most) in enumerate(self.checks)], "check int, name string, least long, most long")
        rows = reduce(DataFrame.unionByName, [df.select(F.lit(i).alias("check")) for i, (_, frames, _, _) in enumerate(self.checks) for df in frames])
        counts = rows.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
        n = F.coalesce("n", F.lit(0))
        found = F.when(F.col("most") < 0, n).otherwise(((n < F.col("least")) | (n > F.col("most"))).cast("long"))
        return named.join(counts, "check", "left").select("name", found.alias("violations"))

    def demand(self, spark: SparkSession) -> None:
        """Raise on the first look if any check fails, naming all that do."""
        if bad := [f"{r.name} ({r.violations})" for r in self.run(spark).collect() if r.violations]:
            raise AssertionError("violated: " + ", ".join(bad))
