"""Residual quantisation codes, retrieval by their prefixes, and the controls of both.

Vectors are put on a grid of whole numbers first, and a centroid is the floor of an exact mean,
so codes do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.work import Scratch, materialise
from .order import with_before
from .skew import hot_keys, salted_join
from .splits import md5_order

#: Steps of the grid to a unit, and its largest number: sums of products of these are exact in doubles.
GRID, LARGEST = 1 << 12, 1 << 22
#: Users a group needs to be asked for its popular items.
LEAST_USERS = 5
#: Shares of a history, in percent, whose codes are compared.
CUTS = (70, 80, 90, 100)


def on_grid(v: Column) -> Column:
    """array<long>: components as the nearest multiples of 1 / GRID."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * GRID + 0.5).cast("long"))


def _floored_means(sums: DataFrame, keys: Sequence[str], d: int) -> DataFrame:
    return sums.select(*keys, F.array(*[F.expr(f"(s{i} - pmod(s{i}, n)) div n") for i in range(d)]).alias("v"))


def _sums(rows: DataFrame, keys: Sequence[str], d: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(d)])


def _located(log: DataFrame, items: DataFrame) -> tuple[DataFrame, int]:
    """``log`` with v, the grid vector of its item, and the number of components; rows whose item has none are left out."""
    row = items.select(F.size("vec")).first()
    placed = items.select("item_id", on_grid(F.col("vec")).alias("v"))
    return salted_join(log, placed, ["item_id"], hot=hot_keys(log, ["item_id"])), row[0] if row else 0


def pooled(log: DataFrame, items: DataFrame) -> DataFrame:
    """(uid, v): the mean of the vectors (item_id, vec) of each user's rows, on the grid."""
    rows, d = _located(log.select("uid", "item_id", "timestamp"), items)
    return _floored_means(_sums(rows, ["uid"], d), ["uid"], d)


# ---- codebooks


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a component is over {LARGEST} steps of the grid")
    return x


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Number of each row's nearest centroid, of equally near ones the first."""
    return ((book * book).sum(1) - 2 * (x @ book.T)).argmin(1)


def learn(vectors: DataFrame, levels: int, size: int, rounds: int, seed: int, key: str = "item_id") -> list[np.ndarray]:
    """Codebooks of ``levels`` levels for ``vectors`` (key, v on the grid): k-means by level on what the levels before left over.

    A level starts from the ``size`` vectors that come first by md5 of seed, level and key. In a
    round every vector is assigned, tasks sum up what they hold, and the driver gets a count and
    a sum a centroid; one without vectors stays. What is left over is written once a level.
    """
    books: list[np.ndarray] = []
    with Scratch(vectors.sparkSession) as tables:
        rest = tables.store(vectors.select(key, "v"))
        for level in range(levels):
            first = rest.orderBy(md5_order(f"{seed}:{level}", key), key).limit(size).select("v").collect()
            book = np.array([r.v for r in first], np.float64).reshape(len(first), len(first[0].v) if first else 0)
            for _ in range(rounds if len(first) else 0):
                book = _moved(rest, book)
            books.append(book)
            if level + 1 < levels and len(first):
                rest = tables.store(_left_over(rest, book))
    return books


def _moved(rest: DataFrame, book: np.ndarray) -> np.ndarray:
    k, d = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in filter(len, batches):
            x = _matrix(batch)
            code = _nearest(x, book)
            count += np.bincount(code, minlength=k)
            np.add.at(total, code, x.astype(np.int64))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, d)), pa.array(np.tile(np.arange(d), len(at))), pa.array(np.repeat(count[at], d)), pa.array(total[at].ravel())], names=["code", "place", "n", "s"])

    moved = book.copy()
    sums = rest.select("v").mapInArrow(run, "code long, place long, n long, s long").groupBy("code", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    for r in sums.collect():  # centroids * components
        moved[r.code, r.place] = r.s // r.n
    return moved


def _left_over(rest: DataFrame, book: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = _matrix(batch)
            x = (x - book[_nearest(x, book)]).astype(np.int64)
            v = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), v], names=batch.schema.names)

    return rest.mapInArrow(run, rest.schema)


def encode(vectors: DataFrame, books: Sequence[np.ndarray]) -> DataFrame:
    """``vectors`` with codes, a centroid's number a level, and residual, the squared length left over after each, in place of v."""
    names = [c for c in vectors.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = _matrix(batch)
            codes, left = [], []
            for book in books:
                codes.append(_nearest(x, book))
                x = x - book[codes[-1]]
                left.append((x * x).sum(1))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.stack(c, 1).ravel().astype(t)), len(books)).cast(pa.list_(kind)) for c, t, kind in ((codes, np.int32, pa.int32()), (left, np.int64, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *lists], names=[*names, "codes", "residual"])

    fields = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in names)
    return vectors.select(*names, "v").mapInArrow(run, f"{fields}, codes array<int>, residual array<bigint>")


def by_level(encoded: DataFrame) -> DataFrame:
    """A row a level: (..., level from 1, code, residual)."""
    each = F.posexplode(F.arrays_zip("codes", "residual")).alias("level", "x")
    return encoded.select(*[c for c in encoded.columns if c not in ("codes", "residual")], each).withColumns({"level": F.col("level") + 1, "code": F.col("x.codes"), "residual": F.col("x.residual")}).drop("x")


def level_report(encoded: DataFrame, size: int) -> DataFrame:
    """(level, used, share, error): codes in use, their share of the codebook, and the mean squared length left over."""
    per_code = by_level(encoded).groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("residual").alias("residual"))
    return per_code.groupBy("level").agg(F.count(F.lit(1)).alias("used"), (F.count(F.lit(1)) / size).alias("share"), (F.sum("residual") / F.sum("n") / float(GRID * GRID)).alias("error"))


# ---- retrieval


def _prefixes(codes: Column, level: Column) -> Column:
    return F.array_join(F.transform(F.slice(codes, 1, level), lambda c: c.cast("string")), ".")


def code_lists(train: DataFrame, coded: DataFrame, queries: DataFrame, levels: int, k: int, least: int = LEAST_USERS) -> DataFrame:
    """(uid, level, used_level, rank, item_id, score): the k most popular items among users who share the first ``level`` codes.

    ``coded`` and ``queries`` are (uid, codes); ``train`` is (uid, item_id), and popularity
    counts its rows. For each level from 1 to ``levels``, the last being the full code, a user
    falls back to a shorter prefix while the longer one's group has under ``least`` users, down
    to all users, level 0. Of equally popular items the smaller id comes first. A group's rows
    are summed by tasks before they meet, and only k rows a group and task are sorted.
    """
    up_to = lambda first: F.explode(F.sequence(F.lit(first), F.lit(levels)))
    groups = coded.select("uid", "codes", up_to(0).alias("used_level")).select("uid", "used_level", _prefixes(F.col("codes"), F.col("used_level")).alias("prefix"))
    sizes = groups.groupBy("used_level", "prefix").agg(F.count(F.lit(1)).alias("users")).filter((F.col("users") >= least) & (F.col("used_level") > 0))
    asked = queries.select("uid", "codes", up_to(1).alias("used_level")).select("uid", "used_level", _prefixes(F.col("codes"), F.col("used_level")).alias("prefix"))
    # groups only shrink with the level, so the longest that is large enough serves all levels from its own on
    fit = salted_join(asked, sizes.select("used_level", "prefix"), ["used_level", "prefix"])
    fit = fit.unionByName(queries.select("uid", F.lit(0).alias("used_level"), F.lit("").alias("prefix")))
    wanted = queries.select("uid", up_to(1).alias("level"))
    chosen = fit.join(wanted, "uid").filter("used_level <= level").groupBy("uid", "level").agg(F.max(F.struct("used_level", "prefix")).alias("x"))
    chosen = materialise(chosen.select("uid", "level", "x.used_level", "x.prefix"))
    plays = train.groupBy("uid", "item_id").agg(F.count(F.lit(1)).alias("n"))
    in_use = salted_join(groups, chosen.select("used_level", "prefix").distinct(), ["used_level", "prefix"])
    items = plays.join(in_use, "uid").groupBy("used_level", "prefix", "item_id").agg(F.sum("n").alias("score"))
    best = W.partitionBy("used_level", "prefix").orderBy(F.col("score").desc(), "item_id")
    lists = items.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return salted_join(chosen, lists, ["used_level", "prefix"]).select("uid", "level", "used_level", "rank", "item_id", "score")


def back_offs(lists: DataFrame) -> DataFrame:
    """(level, users, backed_off, share): how many users fell back to a shorter prefix than they asked for."""
    fell = F.sum((F.col("used_level") < F.col("level")).cast("long"))
    return lists.filter("rank = 1").groupBy("level").agg(F.count(F.lit(1)).alias("users"), fell.alias("backed_off"), (fell / F.count(F.lit(1))).alias("share"))


def permuted(coded: DataFrame, seed: int) -> DataFrame:
    """(uid, codes): each user with the codes of the user who takes their place in a random order; the codes as a whole stay.

    Both numberings, by id and by md5, go by ranges, so no task sees all users.
    """
    by_id = with_before(coded.select("uid"), ["uid"]).withColumnRenamed("before", "__at")
    keyed = coded.select("codes", md5_order(seed, "uid").alias("__key"), F.col("uid").alias("__other"))
    by_key = with_before(keyed, ["__key", "__other"]).select(F.col("before").alias("__at"), "codes")
    return by_id.join(by_key, "__at").select("uid", "codes")


# ---- stability


def history_cuts(log: DataFrame, items: DataFrame, cuts: Sequence[int] = CUTS) -> DataFrame:
    """(uid, cut, v): the pooled vector of the first ``cut`` percent of each user's rows in order of time, rounded up.

    Rows are numbered by ranges of (uid, timestamp, item_id), so a heavy user is no single
    task's, and meet their vectors after that. What lies between two cuts is summed once, and
    each cut adds up what lies below.
    """
    known = salted_join(log.select("uid", "timestamp", "item_id"), items.select("item_id"), ["item_id"], hot=hot_keys(log, ["item_id"]))
    numbered = with_before(known, ["uid", "timestamp", "item_id"])
    sizes = numbered.groupBy("uid").agg(F.min("before").alias("__first"), F.count(F.lit(1)).alias("__n"))
    at = salted_join(numbered, sizes, ["uid"], hot=hot_keys(log, ["uid"]))
    ends = [(c, F.expr(f"({c} * __n + 99) div 100")) for c in sorted(cuts)]
    band = F.coalesce(*[F.when(F.col("before") - F.col("__first") < end, F.lit(c)) for c, end in ends])
    located, d = _located(at.select("uid", "item_id", "before", band.alias("band")).filter("band IS NOT NULL"), items)
    bands = _sums(located, ["uid", "band"], d)
    above = F.explode(F.filter(F.array(*[F.lit(c) for c in sorted(cuts)]), lambda c: c >= F.col("band")))
    both = bands.withColumn("cut", above).groupBy("uid", "cut").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)])
    return _floored_means(both, ["uid", "cut"], d)


def stability(encoded: DataFrame) -> DataFrame:
    """(cut, level, users, equal, share): users whose code at a level is that of their whole history, of ``encoded`` (uid, cut, codes, residual)."""
    rows = by_level(encoded).select("uid", "cut", "level", "code")
    whole = rows.groupBy("uid", "level").agg(F.max(F.struct("cut", "code"))["code"].alias("whole"))
    equal = F.sum((F.col("code") == F.col("whole")).cast("long"))
    return rows.join(whole, ["uid", "level"]).groupBy("cut", "level").agg(F.count(F.lit(1)).alias("users"), equal.alias("equal"), (equal / F.count(F.lit(1))).alias("share"))
