"""Ranking a whole catalogue for each user, and the two baselines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..sources.work import materialise
from .splits import md5_order

#: A part of the grid of users and items holds about so many bytes of items and at most so many users.
ITEM_BYTES, USERS = 64 << 20, 32_768
#: Where the grid would repeat so many bytes of vectors, they are packed to cells of about CELL bytes instead, each written once.
REPEATED, CELL = 2 << 30, 16 << 20
#: Users and items whose scores are in memory at once, at most.
BATCH, BLOCK = 256, 2_048
#: Scores that agree to so many decimals are ties: sums of doubles depend on their order beyond that.
PLACES = 10


def _top(scored: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("uid").orderBy(F.col("score").desc(), "item_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("uid", "rank", "item_id", "score")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array([c.flatten() for c in vectors.chunks], vectors.type.value_type)
    return flat.to_numpy().astype(np.float64).reshape(len(vectors), -1)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row of ``x``, and for all rows which of those they equal."""
    rows = np.ascontiguousarray(x + 0.0)  # no negative zeros
    _, first, which = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, which


def _near(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows of ``x`` in which each ``size`` lie close together: halved at the component that varies most."""
    order, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        low, high = todo.pop()
        if high - low > size:
            part = x[order[low:high]]
            middle = -(-((high - low) // 2) // size) * size
            order[low:high] = order[low:high][np.argpartition(part[:, part.var(0).argmax()], middle)]
            todo += [(low, low + middle), (low + middle, high)]
    return order


class _Items:
    """Item vectors, equal ones once, in blocks of near ones with their centre and radius."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, size: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        first, which = _distinct(x)
        self.n, self.copies, self.k = len(ids), np.bincount(which), k
        by = np.argsort(which, kind="stable")
        self.ids, self.start = ids[by], np.cumsum(self.copies) - self.copies  # the ids of equal ones ascend
        x = x[first]
        self.unit = np.abs(x).max(initial=0) or 1.0
        near = _near((x / self.unit).astype(np.float32), size)
        self.x, self.copies, self.start = x[near], np.minimum(self.copies[near], k), self.start[near]
        self.x32, self.lead = (self.x / self.unit).astype(np.float32), self.ids[self.start]
        self.low = np.arange(0, len(self.x), size)
        self.high = np.append(self.low[1:], len(self.x))
        self.centres = np.stack([self.x[a:b].mean(0) for a, b in zip(self.low, self.high, strict=True)])
        self.radii = np.array([np.linalg.norm(self.x[a:b] - c, axis=1).max() for a, b, c in zip(self.low, self.high, self.centres, strict=True)])
        self.norms = np.array([np.linalg.norm(self.x[a:b], axis=1).max() for a, b in zip(self.low, self.high, strict=True)])

    def best(self, u: np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(ids, scores) of the k best, or of all if they are fewer, for each of a batch of users.

        With a floor for each user only those that reach it count, and are listed as (user's
        number, id, score). A block is scored for the users whose k-th score so far its centre and radius allow it
        to reach. Single precision, with its error bound, only says which pairs are scored in double.
        """
        n, d, k = len(u), u.shape[1], self.k
        length = np.linalg.norm(u, axis=1)
        u32 = (u / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)
        score, place, last = np.full((n, k), -np.inf), np.full((n, k), -1), np.full(n, -np.inf) if floor is None else floor.copy()
        reach = u @ self.centres.T + length[:, None] * self.radii
        reach += 1e-9 * (length[:, None] * (self.norms + self.radii) + 1)
        for b in np.argsort(-reach.max(0)):
            asked = np.flatnonzero(reach[:, b] >= last)
            if not len(asked):
                continue
            low, high = self.low[b], self.high[b]
            with np.errstate(invalid="ignore"):
                slack = (d + 8) * 2.0**-22 * length[asked] * self.norms[b] + np.abs(last[asked]) * 2.0**-22 + 10.0**-PLACES
                cut = (last[asked] - slack) / (np.where(length[asked] > 0, length[asked], 1.0) * self.unit) - d * 1e-43
            rough = u32[asked] @ self.x32[low:high].T
            hit = np.flatnonzero(rough >= np.clip(cut, -3e38, 3e38).astype(np.float32)[:, None])
            if 8 * len(hit) > rough.size:
                full = np.round(u[asked] @ self.x[low:high].T, PLACES)
                edge = np.partition(full, high - low - k, axis=1)[:, high - low - k] if high - low > k else last[asked]
                hit = np.flatnonzero(full >= np.maximum(edge, last[asked])[:, None])
                row, column = np.divmod(hit, high - low)
                row, column, s = asked[row], low + column, full.ravel()[hit]
            else:
                row, column = np.divmod(hit, high - low)
                row, column = asked[row], low + column
                s = np.round(np.einsum("ij,ij->i", u[row], self.x[column]), PLACES)
            better = (s > last[row]) | ((s == last[row]) & ((place[row, -1] < 0) | (self.lead[column] < self.lead[place[row, -1]])))
            if better.any():
                row, column, s = row[better], column[better], s[better]
                some = np.unique(row)
                rows, columns, s = np.concatenate([np.repeat(some, k), row]), np.concatenate([place[some].ravel(), column]), np.concatenate([score[some].ravel(), s])
                order = np.lexsort((self.lead[columns], -s, rows))
                top = order[np.searchsorted(rows[order], some)[:, None] + np.arange(k)]
                score[some], place[some] = s[top], columns[top]
                last[some] = np.maximum(last[some], score[some, -1])
        return self._listed(place, score) if floor is None else self._reached(place, score)

    def _reached(self, place: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of what is at a place, equal items each by their own id."""
        cell, ids = self._each(place, np.where(place >= 0, self.copies[place], 0).ravel())
        return cell // self.k, ids, score.ravel()[cell]

    def _each(self, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.repeat(np.arange(place.size), times)
        return cell, self.ids[self.start[place.ravel()[cell]] + np.arange(len(cell)) - (np.cumsum(times) - times)[cell]]

    def _listed(self, place: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal items each by their own id, of which k are enough."""
        take = min(self.k, self.n)
        times = np.where(place >= 0, self.copies[place], 0).ravel()
        if times.max(initial=0) <= 1 and len(self.x) >= take:
            return self.lead[place[:, :take]], score[:, :take]
        cell, ids = self._each(place, times)
        row, s = cell // self.k, score.ravel()[cell]
        order = np.lexsort((ids, -s, row))
        top = order[np.searchsorted(row[order], np.arange(len(place)))[:, None] + np.arange(take)]
        return ids[top], s[top]


class _Users:
    """User vectors, equal ones once, with the k best of the items that they have met."""

    def __init__(self, uids: np.ndarray, u: np.ndarray, k: int, batch: int) -> None:
        first, which = _distinct(u)
        near = first[_near(u[first], batch)]
        self.uids, self.u, self.k, self.batch = uids, u[near], k, batch
        at = np.empty(len(u), np.int64)
        at[near] = np.arange(len(near))
        self.at = at[first][which]
        self.ids, self.score = np.full((len(near), k), -1), np.full((len(near), k), -np.inf)

    def meet(self, items: _Items) -> None:
        k = self.k
        for low in range(0, len(self.u), self.batch):
            ids, score = self.ids[low : low + self.batch], self.score[low : low + self.batch]
            row, found, s = items.best(self.u[low : low + self.batch], score[:, -1])
            some = np.unique(row)
            row, found, s = np.concatenate([np.repeat(some, k), row]), np.concatenate([ids[some].ravel(), found]), np.concatenate([score[some].ravel(), s])
            order = np.lexsort((found, -s, row))
            top = order[np.searchsorted(row[order], some)[:, None] + np.arange(k)]
            ids[some], score[some] = found[top], s[top]

    def rows(self) -> pa.RecordBatch:
        score, ids = self.score[self.at].ravel(), self.ids[self.at].ravel()
        there = score > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (np.repeat(self.uids, self.k), ids, score)], names=["uid", "item_id", "score"])


def best_items(uids: np.ndarray, u: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, batch: int = BATCH, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """(uid, rank, item_id, score) of the k best items for each user; equal users are ranked once."""
    if not (np.isfinite(u).all() and np.isfinite(x).all()):
        raise ValueError("a vector has a component that is not finite")
    items = _Items(ids, x, k, block)
    first, which = _distinct(u)
    near = first[_near(u[first], batch)]
    found = [items.best(u[near[low : low + batch]]) for low in range(0, len(near), batch)]
    at = np.empty(len(u), np.int64)
    at[near] = np.arange(len(near))
    at = at[first][which]
    best, scores = (np.concatenate(f)[at] for f in zip(*found, strict=True))
    take = best.shape[1]
    return np.repeat(uids, take), np.tile(np.arange(1, take + 1, dtype=np.int32), len(uids)), best.ravel(), scores.ravel()


def rank_blocks(users: DataFrame, items: DataFrame, k: int, item_bytes: int = ITEM_BYTES, user_rows: int = USERS, part_bytes: int = ITEM_BYTES, part_users: int = USERS, repeated: int = REPEATED, cell: int = CELL) -> DataFrame:
    """(uid, rank, item_id, score) by dot product, ties by ascending id: the k best of all items for each user.

    users (uid, vec) and items (item_id, vec) are dealt by hash to the rows and columns of a
    grid of parts; only k rows a user leave a part, and the best of a user's parts are the
    whole's. Within a part, blocks of at most item_bytes of vectors and user_rows users are
    scored by matrix products (see best_items()), so memory and what is moved do not depend on
    the size of a block. Where the grid would repeat more than ``repeated`` bytes, see
    _rank_cells(). More ranks than items are an error, as are vectors that are not finite.
    """
    n_items, dim = items.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if k > n_items:
        raise ValueError(f"{k} ranks from a catalogue of {n_items}")
    columns = max(1, -(-n_items * (dim + 4) * 8 // part_bytes))  # a row's ids and places take some, too
    n_users = users.count()
    rows = max(1, -(-n_users // part_users), -(-users.sparkSession.sparkContext.defaultParallelism // columns))
    block, batch = max(1, min(BLOCK, item_bytes // (8 * dim))), max(1, min(BATCH, user_rows))
    if (n_users * columns + n_items * rows) * (dim + 4) * 8 > repeated:
        cells = [-(-n * (dim + 4) * 8 // cell) for n in (n_users, n_items)]
        return _rank_cells(users, items, k, block, batch, *cells)
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    exact = lambda df: F.col("vec") if df.schema["vec"].dataType == T.ArrayType(T.FloatType()) else F.col("vec").cast("array<double>")
    # names differ, as both sides may be made of the same table
    u = users.select("uid", exact(users).alias("u"), F.pmod(F.xxhash64("uid"), F.lit(rows)).alias("gu"), every(columns, "gi"))
    i = items.select("item_id", exact(items).alias("x"), F.pmod(F.xxhash64("item_id"), F.lit(columns)).alias("gi"), every(rows, "gu"))

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.float64)]
        if left.num_rows and right.num_rows:
            found = best_items(left.column("uid").to_numpy(), _matrix(left.column("u")), right.column("item_id").to_numpy(), _matrix(right.column("x")), k, batch, block)
        return pa.table(dict(zip(("uid", "rank", "item_id", "score"), found, strict=True)))

    found = u.groupBy("gu", "gi").cogroup(i.groupBy("gu", "gi")).applyInArrow(part, "uid long, rank int, item_id long, score double")
    return found if columns == 1 else _top(found.drop("rank"), k)


def _rank_cells(users: DataFrame, items: DataFrame, k: int, block: int, batch: int, user_cells: int, item_cells: int) -> DataFrame:
    """rank_blocks() without a shuffle that repeats vectors.

    Users and items are packed to rows of one cell each and written. All pairs of cells meet by
    reading them again, a user's cell with one of items after the other, and k rows a user leave
    a task. What is moved and written grows with the vectors, and by k rows a user for each
    partition that the items' cells are read in. Of equal items, which are in one cell, k are enough.
    """
    same = W.partitionBy("vec").orderBy("item_id")
    items = items.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k)
    left = _packed(users.select("uid", "vec", F.pmod(F.xxhash64("uid"), F.lit(user_cells)).alias("g")), "uid")
    right = _packed(items.select("item_id", "vec", F.pmod(F.xxhash64("vec"), F.lit(item_cells)).alias("g")), "item_id")
    wide = lambda df: np.float32 if df.schema["vec"].dataType == T.ArrayType(T.FloatType()) else np.float64
    u_type, i_type = wide(users), wide(items)

    def vectors(ids: bytes, x: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids, np.int64)
        x = np.frombuffer(x, kind).reshape(len(ids), -1).astype(np.float64)
        if not np.isfinite(x).all():
            raise ValueError("a vector has a component that is not finite")
        return ids, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch_of_pairs in batches:
            for pair in range(batch_of_pairs.num_rows):
                g, *cell = (c[pair].as_py() for c in batch_of_pairs.columns)
                if g != at:
                    if mine is not None:
                        yield mine.rows()
                    at, mine = g, _Users(*vectors(*cell[:2], u_type), k, batch)
                mine.meet(_Items(*vectors(*cell[2:], i_type), k, block))
        if mine is not None:
            yield mine.rows()

    spark = users.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # a pair or two, stays set
    pairs = left.select("g", F.col("ids").alias("uids"), F.col("x").alias("u")).crossJoin(right.select("ids", "x"))
    return _top(pairs.mapInArrow(run, "uid long, item_id long, score double"), k)


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(g, ids, x), written: the ids and vectors of a group as bytes in one row."""
    kind = T.FloatType() if rows.schema["vec"].dataType == T.ArrayType(T.FloatType()) else T.DoubleType()

    def pack(group: pa.Table) -> pa.Table:
        ids, flat = group.column(key).to_numpy(), np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column("vec").chunks])
        return pa.table({"g": group.column("g")[:1], "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "x": pa.array([flat.tobytes()], pa.binary())})

    return materialise(rows.withColumn("vec", F.col("vec").cast(T.ArrayType(kind))).groupBy("g").applyInArrow(pack, "g long, ids binary, x binary"))


def rank_popular(popularity: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """(uid, rank, item_id, score): one list for all users, by popularity as an integer, ties by id. popularity is (item_id, popularity).

    More ranks than items fail the job that reads the result.
    """
    top = popularity.orderBy(F.col("popularity").desc(), "item_id").limit(k)
    whole = W.partitionBy(F.lit(1)).orderBy(F.col("popularity").desc(), "item_id")  # k rows
    ranked = top.select("item_id", "popularity", F.row_number().over(whole).alias("rank"), F.count(F.lit(1)).over(W.partitionBy(F.lit(1))).alias("n"))
    sound = F.when(F.col("n") == k, F.col("rank")).otherwise(F.raise_error(F.lit(f"{k} ranks from a smaller catalogue")).cast("int"))
    ranked = ranked.select(sound.alias("rank"), "item_id", "popularity")
    return users.select("uid").distinct().crossJoin(F.broadcast(ranked)).select("uid", "rank", "item_id", F.col("popularity").cast("double").alias("score"))


def draws_needed(n_items: int, k: int) -> int:
    """Draws with replacement among which k distinct items are missing with a chance under e**-57, so for none of 1e10 users.

    Too few are drawn only if all lie in one of the C(n, k-1) sets of k-1 items.
    """
    if k == 1:
        return 1
    sets = math.lgamma(n_items + 1) - math.lgamma(k) - math.lgamma(n_items - k + 2)
    return max(k, math.ceil((57 + sets) / math.log(n_items / (k - 1))))


def rank_random(users: DataFrame, n_items: int, k: int, seed: int) -> DataFrame:
    """(uid, rank, item_id, score): k distinct dense ids for each user, uniform, the same on each run.

    Draws are hashed positions, and the first k distinct ones count; draws_needed() says how
    many are made.
    """
    if k > n_items:
        raise ValueError(f"{k} ranks from a catalogue of {n_items}")
    users = users.select("uid").distinct()
    drawn = users.select("uid", F.explode(F.sequence(F.lit(0), F.lit(draws_needed(n_items, k) - 1))).alias("draw")).withColumn("h", md5_order(seed, "uid", "draw"))
    drawn = drawn.select("uid", F.floor(_unit(F.col("h")) * n_items).cast("long").alias("item_id"), "draw")
    first = drawn.groupBy("uid", "item_id").agg(F.min("draw").alias("draw"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("uid").orderBy("draw"))).filter(F.col("rank") <= k)
    return ranked.select("uid", "rank", "item_id", (1.0 - F.col("rank") / float(k + 1)).alias("score"))


def _unit(hexed):
    return F.conv(F.substring(hexed, 1, 12), 16, 10).cast("double") / float(1 << 48)


def log_popularity(popularity: DataFrame) -> DataFrame:
    """(item_id, log_popularity): ln(1 + popularity) of (item_id, popularity)."""
    return popularity.select("item_id", F.log1p("popularity").alias("log_popularity"))


def hits(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """``ranked`` with hit, 1 where the item is among the user's targets (uid, item_id)."""
    wanted = targets.select("uid", "item_id").distinct().withColumn("hit", F.lit(1))
    return ranked.join(wanted, ["uid", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def cut_to_targets(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Ranked rows of users with targets; a target user without a ranking fails the job that reads the result."""
    users = targets.select("uid").distinct()
    sound = lambda c: F.when(F.col("rank").isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit("a user with targets has no ranking")).cast(ranked.schema[c].dataType)).alias(c)
    return users.join(ranked, "uid", "left").select(*[F.col(c) if c == "uid" else sound(c) for c in ranked.columns])
