"""The weekly series over a stream of log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import WEEK
from ..sources.tables import INTERACTIONS

_AT = "__at"


def weekly_counts(events: DataFrame, origin: int, delay: int) -> DataFrame:
    """(week, interactions, active_users) of a stream of (uid, timestamp, ...), as profile.weekly() gives them for a table.

    Weeks count from ``origin`` seconds. A week is given out once, when the stream has passed
    its end by ``delay`` seconds; rows that come later than that are left out, see late_rows().
    Users are counted by week first and then summed, so state and shuffles hold a row a week and
    user, and no week is one task's.
    """
    week = lambda time: F.window(time, f"{WEEK} seconds", startTime=f"{origin % WEEK} seconds")
    timed = events.filter("timestamp IS NOT NULL").withColumn(_AT, F.timestamp_seconds("timestamp")).withWatermark(_AT, f"{delay} seconds")
    by_user = timed.groupBy(week(F.col(_AT)).alias("week"), "uid").agg(F.count(F.lit(1)).alias("n"))
    weeks = by_user.groupBy(week(F.window_time("week")).alias("week")).agg(F.sum("n").alias("interactions"), F.count("uid").alias("active_users"))
    number = ((F.unix_timestamp(F.col("week.start")) - origin) / WEEK).cast("long")
    return weeks.select(number.alias("week"), "interactions", "active_users")


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, origin: int, delay: int, files: int = 1000, schema: T.StructType = INTERACTIONS) -> None:
    """Take all files that ``source`` holds and ``checkpoint`` does not know, and append the weeks that they close to ``sink``.

    State, watermark and the files done are in ``checkpoint``: the next run goes on from there,
    after a crash too. ``files`` are taken at a time, in order of their age.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    weekly_counts(events, origin, delay).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def close(spark: SparkSession, source: str, after: int, delay: int, schema: T.StructType = INTERACTIONS) -> None:
    """End the stream: one row without user so far after ``after`` that all weeks before close. Its own week is never given out."""
    row = [{"timestamp": after + delay + 2 * WEEK}.get(f.name) for f in schema.fields]
    spark.createDataFrame([tuple(row)], schema).coalesce(1).write.mode("append").parquet(source)


def late_rows(spark: SparkSession, source: str, sink: str, origin: int, schema: T.StructType = INTERACTIONS) -> DataFrame:
    """(week, late): rows of ``source`` that came after their week was given out, for each week in ``sink``."""
    there = spark.read.schema(schema).parquet(source).groupBy(F.floor((F.col("timestamp") - origin) / WEEK).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    out = spark.read.schema("week long, interactions long, active_users long").parquet(sink)
    return out.join(there, "week").select("week", (F.col("n") - F.col("interactions")).alias("late"))
