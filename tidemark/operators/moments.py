"""What was known at a moment: decayed popularity before each event, and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.work import materialise

#: Seconds of a bucket at most: rows of one key within a bucket are at most so many, as equal seconds are summed first.
BUCKET = 1 << 16
#: Half-lives that doubles bear on either side of a reference.
SPAN = 256


def decayed_before(log: DataFrame, moments: DataFrame, key: str, half_life: float) -> DataFrame:
    """``moments`` (key, timestamp, ...) with decayed: the rows of ``log`` with the same key before the moment, each halved every ``half_life`` seconds.

    Rows of the very moment do not count, nor any later. A decayed sum is carried as a value and
    the time it holds for. Time is cut into buckets and these into spans: a running sum within
    each bucket, over the buckets of each span, and over the spans, each handed on to the next
    decayed. So the rows of a hot key are dealt by bucket, none longer than BUCKET seconds.
    Null keys or times get 0.
    """
    bucket = max(1, min(BUCKET, int(SPAN * half_life)))
    span = bucket * max(1, int(SPAN * half_life) // bucket)
    down = lambda seconds: F.pow(F.lit(2.0), -(seconds) / F.lit(float(half_life)))
    start = lambda t, width: F.floor(t / F.lit(float(width))).cast("long") * F.lit(width)
    of = lambda df, n, asked: df.select(F.col(key).alias("k"), F.col("timestamp").alias("t"), F.lit(n).cast("long").alias("n"), F.lit(asked).alias("asked"))
    at = of(log, 1, False).unionByName(of(moments, 0, True)).filter("k IS NOT NULL AND t IS NOT NULL").groupBy("k", "t").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    at = at.withColumn("b", start(F.col("t"), bucket)).withColumn("s", start(F.col("b"), span))
    up = lambda t, reference: F.pow(F.lit(2.0), (t - reference) / F.lit(float(half_life)))
    below = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    whole = lambda w: w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # a bucket's sum leaves with its last row, so rows are dealt by bucket once and only sums go on
    here, own = W.partitionBy("k", "b").orderBy("t"), F.col("n") * up(F.col("t"), F.col("b"))
    ends = at.withColumns({"within": F.coalesce(F.sum(own).over(below(here)), F.lit(0.0)), "wanted": F.max("asked").over(whole(here)), "end": F.lead("t").over(here).isNull()})
    ends = ends.filter("asked OR end").select("k", "s", "b", F.when(F.col("asked"), F.col("t")).alias("t"), F.when(F.col("asked"), F.col("within")).alias("within"), F.when(F.col("end"), F.col("within") + own).alias("v"), "wanted")
    ends = materialise(ends)
    spans, earlier, own = W.partitionBy("k", "s").orderBy("b"), W.partitionBy("k").orderBy("s", "b"), F.col("v") * up(F.col("b"), F.col("s"))
    # a key's buckets are no more than the log's time has, and of its spans there are a few
    sums = ends.filter("v IS NOT NULL").select("k", "s", "b", "v", "wanted").repartition("k")
    sums = sums.withColumns({"before_bucket": F.coalesce(F.sum(own).over(below(spans)), F.lit(0.0)), "end": F.lead("b").over(spans).isNull()})
    sums = sums.withColumn("earlier", F.collect_list(F.when(F.col("end"), F.struct("s", (F.col("before_bucket") + own).alias("v")))).over(below(earlier)))
    carried = F.aggregate("earlier", F.lit(0.0), lambda sum_, x: sum_ + x["v"] * down(F.col("s") - x["s"]))
    buckets = sums.filter("wanted").select("k", "b", ((F.col("before_bucket") + carried) * down(F.col("b") - F.col("s"))).alias("before_bucket"))
    here = ends.filter("t IS NOT NULL").select("k", "b", "t", "within").join(buckets, ["k", "b"])
    values = here.select(F.col("k").alias(key), F.col("t").alias("timestamp"), ((F.col("within") + F.col("before_bucket")) * down(F.col("t") - F.col("b"))).alias("decayed"))
    return moments.join(values, [key, "timestamp"], "left").withColumn("decayed", F.coalesce("decayed", F.lit(0.0)))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, columns: dict[str, str], strict: bool = True) -> DataFrame:
    """``left`` with the columns of the last row of ``right`` of the same keys before its time, or up to it if not strict; null if there is none.

    ``columns`` names what is taken of ``right`` and what it is called. Of right rows of one
    time the largest counts, in order of ``columns``. Both sides are one table, dealt to tasks by
    ranges of keys and time; a task carries forward within its range, and its last known row is
    handed to the ranges above it, so a hot key is split like any other. Left rows with a null
    key or time get nulls.
    """
    mine = F.struct(*[F.col(c) for c in left.columns])
    taken = F.struct(*[F.col(c).alias(new) for c, new in columns.items()])
    # at one time, right rows come after left ones if only earlier rows count
    l_side = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), mine.alias("__left"), F.lit(None).cast(right.select(taken.alias("x")).schema["x"].dataType).alias("__right"))
    r_side = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(l_side.schema["__left"].dataType).alias("__left"), taken.alias("__right"))
    names = [f"__k{i}" for i in range(len(keys))]
    r_side = r_side.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*names, "__t"]))
    order = [*names, "__t", "__side", "__right"]
    tie = F.xxhash64("__left", "__right").alias("__tie")  # rows of one key and time can lie in several ranges
    rows = l_side.unionByName(r_side).select("*", tie).repartitionByRange(*order, "__tie").withColumn("__part", F.spark_partition_id())
    rows = materialise(rows)
    key = F.struct(*names)
    known = F.last("__right", ignorenulls=True).over(W.partitionBy("__part", *names).orderBy("__t", "__side", F.col("__right").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    last = F.max(F.when(F.col("__right").isNotNull(), F.struct(key.alias("key"), "__t", "__right"))).alias("last")  # a range's last right row is that of its largest key and time
    edges = rows.groupBy("__part").agg(last)
    edges = edges.select("__part", F.last("last", ignorenulls=True).over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)).alias("__edge"))  # a row a task
    found = rows.withColumn("__known", known).filter(F.col("__left").isNotNull()).join(F.broadcast(edges), "__part")
    handed = F.when((F.col("__edge.key") == key) & (F.col("__edge.__t") <= F.col("__t")), F.col("__edge.__right"))
    best = F.coalesce("__known", handed)
    return found.select("__left.*", *[best[new].alias(new) for new in columns.values()])


def last_before(log: DataFrame, moments: DataFrame, key: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """``moments`` with the ``columns`` of the last earlier row of the same ``key``, under names with ``prefix``."""
    return as_of(moments, log, [key], "timestamp", {c: prefix + c for c in columns})

