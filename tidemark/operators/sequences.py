"""Time-ordered item sequences of users, and training batches made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import leak_check, to_dense


def grouped_items(log: DataFrame) -> DataFrame:
    """(uid, items): the distinct items of each user, ascending."""
    return log.groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def sequences(log: DataFrame, id_map: DataFrame) -> DataFrame:
    """(uid, items): dense ids in order of time, equal times by raw id."""
    rows = to_dense(log.select("uid", "timestamp", "item_id"), id_map)
    timed = F.array_sort(F.collect_list(F.struct("timestamp", "item_id", "dense_id")))
    return rows.groupBy("uid").agg(F.transform(timed, lambda x: x["dense_id"]).alias("items"))


def prefixes(train: DataFrame, val: DataFrame, id_map: DataFrame, split: str, cutoff: int) -> DataFrame:
    """Histories to predict ``split`` from: train for val, train and val for test; all before the cutoff."""
    if split not in ("val", "test"):
        raise ValueError(f"no prefixes for split {split!r}")
    log = train if split == "val" else train.unionByName(val)
    return sequences(leak_check(log, cutoff, f"{split} prefix"), id_map)


def tail(items: Column, n: int) -> Column:
    """The last ``n`` of an array, or all of a shorter one."""
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def next_items(seqs: DataFrame, max_len: int) -> DataFrame:
    """(uid, items, positives): each position and what follows it, the last ``max_len`` of users with two items or more."""
    s = F.col("items")
    both = seqs.filter(F.size("items") >= 2)
    return both.select("uid", tail(F.slice(s, 1, F.size(s) - 1), max_len).alias("items"), tail(F.slice(s, 2, F.size(s) - 1), max_len).alias("positives"))


def eval_state(seqs: DataFrame, max_len: int, users: DataFrame | None = None) -> DataFrame:
    rows = seqs if users is None else seqs.join(users.select("uid").distinct(), "uid", "left_semi")
    return rows.filter(F.size("items") > 0).select("uid", tail(F.col("items"), max_len).alias("items"))


def flattened(seqs: DataFrame) -> DataFrame:
    """(uid, length, pos, item): a row an item, from position 0."""
    return seqs.select("uid", F.size("items").alias("length"), F.posexplode("items").alias("pos", "item"))


def padded(seqs: DataFrame, max_len: int) -> DataFrame:
    """(uid, padded, mask, positions): left-aligned to ``max_len`` with zeros; positions count back from the newest, 0."""
    s = F.col("items")
    n = F.size(s)
    fill = F.greatest(F.lit(max_len) - n, F.lit(0))
    zero = F.lit(0).cast("long")
    return seqs.select(
        "uid", F.concat(s, F.array_repeat(zero, fill)).alias("padded"), F.concat(F.transform(s, lambda x: F.lit(True)), F.array_repeat(F.lit(False), fill)).alias("mask"),
        F.concat(F.transform(s, lambda x, j: (n - 1 - j).cast("long")), F.array_repeat(zero, fill)).alias("positions"),
    )
