"""Centroid clustering against loops over all distances."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow_clusters(rows, k, rounds, d):
    kept = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in rows if v is not None and len(v) == d and None not in v and np.isfinite(v).all()]
    order = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"1:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1].tolist()))
    centres = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        label = [min(range(len(centres)), key=lambda c: (int(((v - centres[c]) ** 2).sum()), c)) for _, v in kept]
        if turn == rounds:
            break
        groups = [[v for (_, v), at in zip(kept, label, strict=True) if at == c] for c in range(len(centres))]
        centres = [np.array([int(x) // len(g) for x in sum(g)]) if g else c for c, g in zip(centres, groups, strict=True)]
    per = {c: sum(int(((v - centres[c]) ** 2).sum()) for (_, v), at in zip(kept, label, strict=True) if at == c) for c in set(label)}
    sha = {c: hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest() for c in set(label)}
    return [(i, at, int(((v - centres[at]) ** 2).sum()), per[at], sum(per.values()), sha[at]) for (i, v), at in zip(kept, label, strict=True)]


def points(rng, n, d):
    centre = rng.normal(size=(5, d))
    return (centre[rng.integers(0, 5, n)] + 0.2 * rng.normal(size=(n, d))).astype(np.float32).tolist()


def test_clusters_equal_loops(spark):
    rng = np.random.default_rng(3)
    rows = list(enumerate(points(rng, 700, 64)))
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(1, rows[1][1]), (5000, None), (5001, []), (5002, [1.0] * 63), (5003, [None] + [1.0] * 63), (5004, [float("nan")] * 64), (5005, [float("inf")] * 64)]
    rows += [(None, rows[2][1]), (6000, [-1.5] * 64)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"cluster": F.lit("x"), "v": F.lit("x"), "distance": F.lit("x")}).repartition(4)
    expected = sorted(slow_clusters(rows, 16, 3, 64), key=str)
    for block in (50, 8192):
        assert sorted((tuple(r) for r in centroids.report(*centroids.clusters(df, block=block)).collect()), key=str) == expected


def test_few_and_no_vectors(spark):
    rows = [(3, [1.0, 2.0]), (4, [1.0, 2.0]), (9, [0.0, 5.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in centroids.report(*centroids.clusters(df, dimensions=2)).collect()) == sorted(slow_clusters(rows, 16, 3, 2))
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.report(*centroids.clusters(empty)).collect() == []
    with pytest.raises(Exception, match="component"):
        centroids.clusters(spark.createDataFrame([(1, [1e30, 0.0], 0)], SCHEMA), dimensions=2)


def test_filter_equals_all_distances_and_spares_work():
    rng = np.random.default_rng(4)
    for d, scale in ((2, 1000), (3, 4), (64, 100), (2, 1 << 24)):
        x = (scale * np.concatenate([rng.normal(size=(1500, d)), 5 + rng.normal(size=(1500, d)), np.ones((400, d))])).astype(np.int64)
        tree, order = centroids.build(x)
        assert (tree.points == x[order]).all() and (tree.sums[0] == x.sum(0)).all() and sorted(order) == list(range(len(x)))
        centres = np.concatenate([x[rng.integers(0, len(x), 14)], x[:1], x[:1]])  # ties
        label, whole, _ = centroids.filtered(tree, centres)
        away = ((x[order][:, None, :] - centres[None]) ** 2).sum(2)
        assert (label == away.argmin(1)).all()
        counts, sums = centroids.gathered(tree, centres)
        for c in range(16):
            assert counts[c] == (label == c).sum() and (sums[c] == x[order][label == c].sum(0)).all()
        if d == 2:
            assert whole > len(x) / 4
    tree, _ = centroids.build(np.zeros((1, 3), np.int64))
    assert centroids.filtered(tree, np.array([[1, 0, 0], [0, 0, 0]]))[0].tolist() == [1]
