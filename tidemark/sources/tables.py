"""Scans: Parquet tables, the interaction log made from orders, and item vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The interaction log: one row a listen, no nulls. Unsigned source types widen.
INTERACTIONS = T.StructType([
    T.StructField("uid", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("timestamp", T.LongType()),
    T.StructField("is_organic", T.ShortType()), T.StructField("played_ratio_pct", T.IntegerType()), T.StructField("track_length_seconds", T.LongType()),
])
VECTOR_COLUMNS = ("normalized_embed", "embed", "embedding")


def scan(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table, or the given columns of it; the Parquet scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scan_union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with the same column names."""
    return reduce(DataFrame.unionByName, frames)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as an interaction log: customers listen to parts; time is seconds since the first order."""
    orders = scan(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    lines = scan(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_returnflag", "l_quantity"])
    parts = scan(spark, sf_dir, "part", ["p_partkey", "p_size"])
    start = orders.agg(F.min(F.unix_timestamp("o_orderdate"))).first()[0] or 0
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("uid"), F.col("l_partkey").alias("item_id"), (F.unix_timestamp("o_orderdate") - start).alias("timestamp"),
            F.when(F.col("l_returnflag") == "N", 1).otherwise(0).cast("short").alias("is_organic"),
            (F.col("l_quantity") * 2).cast("int").alias("played_ratio_pct"), (F.col("p_size") * 5).cast("long").alias("track_length_seconds"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, vec) of the items that have one."""
    df = scan(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("item_id"), F.col(vector_column(df)).alias("vec"))


def vector_column(df: DataFrame) -> str:
    """The first of the names that a table of vectors may use."""
    for name in VECTOR_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"no vector column among {df.columns}; looked for {VECTOR_COLUMNS}")
