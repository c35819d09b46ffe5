"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded random order, repeated up to ``epochs``
times. A copy's virtual finish time is the running word count of its queue divided by the
source's target, so all queues reach time 1 when their targets are met. All copies are
range-sorted by finish time, and the order is truncated where the total budget is spent.

Running sums within a source are made from sums of (source, key range) buckets, and those of
the global order from sums of its ranges, so neither has to pass through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.order import with_before
from .common import WORD, materialise

#: Bits of the shuffle key and of those that name a bucket of it.
KEY_BITS, BUCKET_BITS = 60, 12


def shuffle_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A 60-bit key from md5 of the id, the same in any engine; a row without id is shuffled by its text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("~"), F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """(skey, source_size, target): ``share`` of all words by weight, at most ``epochs`` times a source's size.

    Sources are weighted in code-point order, null last, by ``weights`` in rotation. The level
    that spends the budget is the largest of the levels that cap the first i sources by
    size/weight, so the resharing of what capped sources leave needs no loop. Sources are
    ordered by ranges, however many there are.
    """
    src = sizes.groupBy(F.when(F.col("skey") == "", 1).otherwise(0).alias("none"), "skey").agg(F.sum("size").alias("source_size"))
    turn = (F.col("before") % len(weights) + 1).cast("int")
    src = with_before(src, ["none", "skey"]).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn)).drop("before")
    src = src.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    src = with_before(with_before(src, ["ratio", "skey"], "cap").withColumnRenamed("before", "caps"), ["ratio", "skey"], "w").withColumnRenamed("before", "ws")
    all_words, all_w = src.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(float(share)) * F.lit(all_words or 0) - F.col("caps")) / (F.lit(float(all_w or 0)) - F.col("ws"))
    top = src.agg(F.max(level)).first()[0]
    return src.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.lit(top).cast("double") * F.col("w")).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` is the words the mix takes from the row, a multiple of its size from 0 to
    ``epochs``. A null or empty text has size 0 and nothing taken; a null source is a source of
    its own; a null id counts by its text; equal ids share a key and follow one another (by size); an empty table gives an
    empty result. Columns of ``docs`` other than doc_id, text and source are not read.
    """
    sizes = materialise(docs.select(
        "doc_id", "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        shuffle_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
    ).withColumn("bucket", F.shiftright("key", KEY_BITS - BUCKET_BITS)))
    targets = source_targets(sizes, weights, share, epochs)
    offsets = (
        sizes.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
        .withColumn("offset", F.coalesce(F.sum("words").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(targets, "skey").drop("words")
    )
    queue = W.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    timed = materialise(
        sizes.withColumn("run", F.sum("size").over(queue)).join(offsets, ["skey", "bucket"])
        .select("doc_id", "source", "skey", "size", "source_size", "target", (F.col("offset") + F.col("run")).alias("cum"))
    )
    total = sizes.agg(F.sum("size")).first()[0] or 0
    last = _last_taken(timed, float(share) * total, epochs)
    taken = F.lit(0).cast("long")
    for epoch in range(epochs):
        cum = F.col("cum") + epoch * F.col("source_size")
        time = F.try_divide(cum, F.col("target"))
        key = F.struct(time.alias("time"), F.col("skey"), cum.alias("cum"))
        taken = taken + F.when((F.col("size") > 0) & (key <= last), F.col("size")).otherwise(0)
    return timed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def _last_taken(timed: DataFrame, budget: float, epochs: int) -> Column:
    """The (time, skey, cum) of the last copy within the budget, in the global order of copies."""
    cum = lambda e: F.col("cum") + e * F.col("source_size")
    each = F.explode(F.array(*[F.struct((cum(e) / F.col("target")).alias("time"), cum(e).alias("cum")) for e in range(epochs)])).alias("c")
    copies = timed.filter("size > 0").select("skey", "size", each).select("c.time", "skey", "c.cum", "size")
    within = with_before(copies, ["time", "skey", "cum"], "size").filter(F.col("before") + F.col("size") <= budget)
    time, skey, last = within.agg(F.max(F.struct("time", "skey", "cum"))).first()[0] or (-1.0, "", -1)
    return F.struct(F.lit(time).alias("time"), F.lit(skey).alias("skey"), F.lit(last).cast("long").alias("cum"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` that mix() takes, each as often as it is taken.

    Texts move once, to meet their counts; rows without words have nothing to take and go.
    Equal ids are told apart by source and size, so what the mix takes from equal rows is theirs in turn.
    """
    columns = docs.columns
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = lambda n: F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), n, F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    plan = (
        mix(docs, **how).filter("size > 0").groupBy(key(F.col("size")).alias("__key"))
        .agg(F.count(F.lit(1)).alias("__rows"), F.sum(F.col("taken") / F.col("size")).cast("long").alias("__copies")).filter("__copies > 0")
    )
    rows = docs.select(*columns, key(size).alias("__key")).join(plan, "__key")
    nth = F.row_number().over(W.partitionBy("__key").orderBy("text"))
    shared = F.floor(F.col("__copies") / F.col("__rows")) + F.when(nth <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    # Only rows that share a key have to be told apart by their text.
    rows = rows.filter("__rows = 1").withColumn("__n", F.col("__copies")).unionByName(rows.filter("__rows > 1").withColumn("__n", shared).filter("__n > 0"))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*columns)


#: DuckDB SQL for the rows of op1.
SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), src AS (
  SELECT skey, sum(size)::BIGINT AS source_size FROM s GROUP BY skey
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY skey = '', skey) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2 * source_size AS cap
  FROM src
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT skey, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM levels
), queue AS (
  SELECT s.*, source_size, target,
         sum(size) OVER (PARTITION BY s.skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM s JOIN targets USING (skey)
), copies AS (
  SELECT doc_id, skey, size, cum + e * source_size AS c, (cum + e * source_size) / target AS t
  FROM queue, (SELECT unnest([0, 1]) AS e) WHERE size > 0
), served AS (
  SELECT *, sum(size) OVER (ORDER BY t, skey, c) AS total, 1.5::DOUBLE * (SELECT sum(size) FROM s) AS budget FROM copies
), got AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM served WHERE total <= budget GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queue LEFT JOIN got USING (doc_id)
"""
