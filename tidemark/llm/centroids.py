"""Centroid clustering of integer vectors, with kd-trees that spare most distances.

Each task builds kd-trees over blocks of its vectors and writes them: for every node the count,
the integer sum of its vectors and their bounding box. In a round a tree is walked from its root
with all centroids. Where one centroid is strictly nearer than another to even the corner of the
box that favours the other most, the other is out for the whole node; a node with one centroid
left is assigned at once by its count and sum, and leaves are resolved vector by vector. All
arithmetic is on whole numbers, so ties and sums are exact, and nothing depends on how vectors
are dealt to tasks. What reaches the driver is a count and a sum a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialise

DIMENSIONS, SCALE = 64, 64
CENTROIDS, ROUNDS, SEED = 16, 3, 1
#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 8192, 32
#: Up to this size of components products and their sums are exact in doubles; up to the other in 64-bit integers.
_DOUBLES, LARGEST = 1 << 22, 1 << 27


class Tree(NamedTuple):
    """Points in the order of the leaves; node i has the children 2 i + 1 and 2 i + 2 and the points start[i] to end[i]."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree of points (at least one), and the order they are in."""
    n, order = len(points), np.arange(len(points))
    depth = max(0, int(np.ceil(np.log2(n / leaf)))) if n > leaf else 0
    start, end = np.zeros((2 << depth) - 1, np.int64), np.zeros((2 << depth) - 1, np.int64)
    end[0] = n
    for i in range((1 << depth) - 1):
        a, b = start[i], end[i]
        mid = (a + b) // 2
        if b - a > 1:
            of = points[order[a:b]]
            widest = int(np.argmax(of.max(0) - of.min(0)))
            order[a:b] = order[a:b][np.argpartition(of[:, widest], mid - a)]
        start[2 * i + 1], end[2 * i + 1], start[2 * i + 2], end[2 * i + 2] = a, mid, mid, b
    points = points[order]
    first = (1 << depth) - 1  # of the leaves
    shape = (len(start), points.shape[1])
    sums, low, high = np.zeros(shape, np.int64), np.full(shape, LARGEST, np.int64), np.full(shape, -LARGEST, np.int64)
    full = first + np.flatnonzero(end[first:] > start[first:])
    sums[full], low[full], high[full] = (f.reduceat(points, start[full], axis=0) for f in (np.add, np.minimum, np.maximum))
    for i in range(first - 1, -1, -1):
        both = [2 * i + 1, 2 * i + 2]
        sums[i], low[i], high[i] = sums[both].sum(0), low[both].min(0), high[both].max(0)
    return Tree(points, start, end, sums, low, high), order


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= _DOUBLES:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) and centres (columns)."""
    return (points * points).sum(1)[:, None] - 2 * _product(points, centres) + (centres * centres).sum(1)


def filtered(tree: Tree, centres: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(nearest centre of each point, of equally near ones the first; points assigned by node; points resolved)."""
    k = len(centres)
    label = np.zeros(len(tree.points), np.int64)
    norm = (centres * centres).sum(1)
    apart = centres[None, :, :] - centres[:, None, :]  # [star, z]: z - star
    up, down = np.maximum(apart, 0), np.minimum(apart, 0)
    node, alive = np.array([0]), np.ones((1, k), bool)
    leaves = len(tree.start) // 2
    whole = 0
    open_nodes = []
    while len(node):
        full = tree.end[node] > tree.start[node]
        node, alive = node[full], alive[full]
        low, high = tree.low[node], tree.high[node]
        middle = distances(low + high, 2 * centres)
        star = np.where(alive, middle, np.iinfo(np.int64).max).argmin(1)
        for s in np.unique(star):
            at = np.flatnonzero(star == s)
            # |z - x|^2 - |star - x|^2 at the corner x of the box that is best for z
            gain = norm[None, :] - norm[s] - 2 * (_product(high[at], up[s]) + _product(low[at], down[s]))
            alive[at] &= gain <= 0
        done = alive.sum(1) == 1
        for i, s in zip(node[done].tolist(), alive[done].argmax(1).tolist(), strict=True):
            label[tree.start[i] : tree.end[i]] = s
            whole += int(tree.end[i] - tree.start[i])
        node, alive = node[~done], alive[~done]
        last = node >= leaves
        open_nodes += node[last].tolist()
        node, alive = node[~last], alive[~last]
        node, alive = np.concatenate([2 * node + 1, 2 * node + 2]), np.concatenate([alive, alive])
    if open_nodes:
        at = np.concatenate([np.arange(tree.start[i], tree.end[i]) for i in open_nodes])
        label[at] = distances(tree.points[at], centres).argmin(1)  # a centre that is out is strictly farther
    return label, whole, len(label) - whole


def gathered(tree: Tree, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points of each centre: nodes assigned whole give theirs."""
    k, counts, sums = len(centres), np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
    label, _, _ = filtered(tree, centres)
    node = np.array([0])
    leaves = len(tree.start) // 2
    edge = np.flatnonzero(np.diff(label)) + 1  # where labels change
    while len(node):
        node = node[tree.end[node] > tree.start[node]]
        one = np.searchsorted(edge, tree.start[node], "right") == np.searchsorted(edge, tree.end[node] - 1, "right")
        of = label[tree.start[node[one]]]
        np.add.at(counts, of, tree.end[node[one]] - tree.start[node[one]])
        np.add.at(sums, of, tree.sums[node[one]])
        node = node[~one]
        for i in node[node >= leaves].tolist():
            part = label[tree.start[i] : tree.end[i]]
            hot = (part[:, None] == np.arange(k)).astype(np.int64)
            counts += hot.sum(0)
            sums += hot.T @ tree.points[tree.start[i] : tree.end[i]]
        node = node[node < leaves]
        node = np.concatenate([2 * node + 1, 2 * node + 2])
    return counts, sums


# ---- on Spark


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors with exactly so many components, none null or not finite, as floor(scale * component)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter((F.size("embedding") == dimensions) & finite)
    return kept.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))


_TREE = "ids array<bigint>, dimensions int, points binary, start binary, end binary, sums binary, low binary, high binary"


def _planted(kept: DataFrame, dimensions: int, block: int) -> DataFrame:
    """A row a kd-tree."""

    def row(ids: list, points: np.ndarray) -> pa.RecordBatch:
        if np.abs(points).max() > LARGEST:
            raise ValueError(f"a component is over {LARGEST}: squared distances would not fit 64 bits")
        tree, order = build(points)
        columns = [pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([dimensions], pa.int32()), *(pa.array([np.ascontiguousarray(a, "<i8").tobytes()], pa.binary()) for a in tree)]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "dimensions", "points", "start", "end", "sums", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        got: list[np.ndarray] = []
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                if len(ids) + part.num_rows > block:
                    yield row(ids, np.concatenate(got))
                    ids, got = [], []
                ids += part.column("vec_id").to_pylist()
                got.append(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions))
        if ids:
            yield row(ids, np.concatenate(got))

    return in_batches(kept, 4096).mapInArrow(run, _TREE)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            d = batch.column("dimensions")[i].as_py()
            points, start, end, *rest = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("points", "start", "end", "sums", "low", "high"))
            yield batch.column("ids").slice(i, 1).flatten(), Tree(points.reshape(-1, d), start, end, *(a.reshape(-1, d) for a in rest))


def _moved(trees: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres after one round: floors of exact means; one without vectors stays."""
    k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for _, tree in _trees(batches):
            n, s = gathered(tree, centres)
            counts, sums = counts + n, sums + s
        at = np.flatnonzero(counts)
        rows = np.concatenate([counts[at, None], sums[at]], axis=1)
        columns = [np.repeat(at, d + 1), np.tile(np.arange(d + 1), len(at)), rows.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "place", "x"])

    total = trees.mapInArrow(run, "cluster long, place long, x long").groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found: dict[int, dict[int, int]] = {}
    for r in total.collect():  # centroids * (dimensions + 1) rows
        found.setdefault(r.cluster, {})[r.place] = int(r.x)
    out = centres.copy()
    for c, by_place in found.items():
        out[c] = [by_place[p] // by_place[0] for p in range(1, d + 1)]
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector (vec_id, embedding), and the final centroids as rows.

    Vectors that whole_vectors() drops have no row. The first centroids are the k kept vectors
    with the smallest sha256 of ``<seed>:<vec_id>``, in that order, of equal ids the smaller
    vector first; fewer vectors make fewer centroids. A null id keeps its row but is never a
    first centroid unless there are too few others. Repeated rows count each by itself. Of
    equally near centroids the smaller number wins. Without vectors there is no row. A component
    over 2^27 is an error, as distances would not fit their type.
    """
    kept = whole_vectors(vectors, dimensions, scale)
    trees = materialise(_planted(kept, dimensions, block))
    named = kept.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"))
    first = named.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centres = np.array([r.v for r in first], np.int64).reshape(-1, dimensions)
    if len(centres):
        in_batches(trees, 1)
        for _ in range(rounds):
            centres = _moved(trees, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches):
            label, _, _ = filtered(tree, centres)
            off = tree.points - centres[label]
            yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array((off * off).sum(1))], names=["vec_id", "cluster", "distance"])

    return materialise(trees.mapInArrow(run, "vec_id long, cluster int, distance long")), centres


def report(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256."""
    per = {r.cluster: int(r.n) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # a row a centroid
    total = sum(per.values())
    rows = [(c, n, total, hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, n in sorted(per.items())]
    known = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    kept = f"""
kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) <= {k})"""

    def nearest(i: int) -> str:
        away = "list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"""
d{i} AS (SELECT row, vec_id, kept.v, c.c, CAST({away} AS BIGINT) AS d FROM kept, c{i} c),
a{i} AS (SELECT row, vec_id, v, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"""

    def means(i: int) -> str:
        return f"""
m{i} AS (SELECT c, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
  SELECT c, place, CAST(sum(v[place]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{i - 1}, range(1, {dimensions + 1}) r(place) GROUP BY c, place)),
c{i} AS (SELECT c0.c, coalesce(n.v, c0.v) AS v FROM c{i - 1} c0 LEFT JOIN (SELECT c, list(x ORDER BY place) AS v FROM m{i} GROUP BY c) n ON n.c = c0.c)"""

    steps = [kept]
    for i in range(rounds):
        steps += [nearest(i), means(i + 1)]
    steps.append(nearest(rounds))
    return f"""WITH {",".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


SQL = _sql()
