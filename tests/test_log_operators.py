"""Interaction-log operators on hand-made rows."""

import math
import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import DAY
from tidemark.operators import cleaning, metrics, neural, profile, ranking, sequences, significance, splits, vectors
from tidemark.sources import schema, sinks, tables
from tidemark.sources.work import shared_dir

LOG = "uid long, item_id long, timestamp long, is_organic short, played_ratio_pct int, track_length_seconds long"


def log(spark, rows):
    return spark.createDataFrame([(u, i, t, o, p, n) for u, i, t, o, p, n in rows], LOG)


def simple(spark, rows):
    return spark.createDataFrame(rows, "uid long, timestamp long, item_id long")


def ranked(spark, lists):
    return spark.createDataFrame([(u, r + 1, i) for u, items in lists.items() for r, i in enumerate(items)], "uid long, rank int, item_id long")


def targets(spark, sets):
    return spark.createDataFrame([(u, i) for u, items in sets.items() for i in items], "uid long, item_id long")


def value(spark, lists, sets, name, n_items=100):
    return metrics.evaluate(ranked(spark, lists), targets(spark, sets), n_items, [name]).first()["value"]


def test_schema_validation(spark):
    good = log(spark, [(1, 2, 3, 1, 60, 5)])
    assert schema.validate(good.withColumn("extra", F.lit(1)), tables.INTERACTIONS, "t").count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        schema.validate(good.drop("uid"), tables.INTERACTIONS, "t")
    with pytest.raises(ValueError, match="wrong types"):
        schema.validate(good.withColumn("uid", F.col("uid").cast("int")), tables.INTERACTIONS, "t")
    with pytest.raises(ValueError, match="nulls"):
        schema.validate(log(spark, [(None, 2, 3, 1, 60, 5)]), tables.INTERACTIONS, "t")


def test_dedup_and_threshold(spark):
    rows = [(1, 1, 5, 0, 60, 10), (1, 1, 5, 0, 60, 10), (1, 1, 5, 1, 80, 9), (1, 1, 5, 0, 80, 12), (2, 1, 5, 0, 50, 1), (2, 1, 6, 0, 49, 1), (2, 2, 6, 0, 159, 1)]
    df = log(spark, rows)
    assert cleaning.exact_dedup(df).count() == 6
    assert [r["count"] for r in cleaning.collisions(cleaning.exact_dedup(df)).collect()] == [3]
    kept = cleaning.key_dedup(df)
    assert kept.filter("uid = 1").first()["track_length_seconds"] == 12 and cleaning.collisions(kept).isEmpty()
    assert sorted(r.played_ratio_pct for r in cleaning.played(kept, 50).collect()) == [50, 80, 159]


def test_unique_keys_hold_no_table_beside_the_grouping(spark):
    df = spark.createDataFrame([(1, 5, 2, 1, 60, 10), (1, 5, 2, 0, 70, 10), (1, None, 2, 1, 60, 10), (1, None, 2, 1, 60, 10), (2, 5, 2, 1, 60, 10)], tables.INTERACTIONS.fieldNames())
    assert not cleaning.unique_keys(df).first().ok
    once = cleaning.unique_keys(cleaning.key_dedup(df))
    assert once.first().ok and cleaning.unique_keys(df.limit(0)).first().ok
    assert once._jdf.queryExecution().sparkPlan().toString().count("HashAggregate(keys=[uid") == 2  # by tasks, and of all


def test_min_counts_takes_both_from_one_snapshot(spark):
    rows = [(u, i, 0, 0, 60, 1) for u in range(4) for i in range(3)] + [(9, 0, 0, 0, 60, 1), (9, 7, 0, 0, 60, 1), (8, 7, 0, 0, 60, 1)]
    out, rounds = cleaning.min_counts(log(spark, rows), 3, 3)
    assert out.count() == 12 and rounds == 2
    again, rounds = cleaning.min_counts(out, 3, 3)
    assert again.count() == 12 and rounds == 1
    assert cleaning.min_counts(log(spark, rows), 50, 1)[0].isEmpty()
    with pytest.raises(RuntimeError):
        cleaning.min_counts(log(spark, rows), 3, 3, max_rounds=1)


def test_loss(spark):
    before = log(spark, [(u, i, 0, 0, 60, 1) for u in range(4) for i in range(10)])
    after = before.filter("uid = 0 OR (uid = 1 AND item_id < 2) OR (uid = 2 AND item_id < 5)")
    row = cleaning.loss_profile(cleaning.loss_by_user(before, after)).first()
    assert (row.users, row.fully_lost, row.heavy_loss, row.loss_p50) == (4, 1, 1, 0.5)


def test_splits(spark):
    df = log(spark, [(u, i, t * DAY, 0, 60, 1) for u, i, t in [(1, 1, 0), (1, 2, 1), (1, 1, 70), (2, 3, 75), (1, 2, 85), (1, 9, 86), (1, 1, 99)]])
    cut = splits.choose_cutoffs(df, 14 * DAY, 14 * DAY, 1)
    assert (cut.val, cut.test) == (71 * DAY, 85 * DAY)
    train, val, test = splits.split(df, cut)
    assert (train.count(), val.count(), test.count()) == (3, 1, 3)
    assert splits.warm(val, train).isEmpty() and sorted(r.item_id for r in splits.warm(test, train).collect()) == [1, 2]
    warm_test = splits.warm(test, train)
    checks = {r.name: r.violations == 0 for r in splits.split_invariants(train, warm_test.limit(0), warm_test, cut, 7).run(spark).collect()}
    assert not checks.pop("validation has rows") and all(checks.values()) and len(checks) == 13
    with pytest.raises(AssertionError, match="test items in train"):
        splits.split_invariants(train, val, test, cut).demand(spark)
    with pytest.raises(ValueError, match="rows"):
        splits.choose_cutoffs(df, 14 * DAY, 14 * DAY, 100)
    with pytest.raises(ValueError, match="no time"):
        splits.choose_cutoffs(df, 50 * DAY, 50 * DAY, 1)
    with pytest.raises(ValueError):
        splits.Cutoffs(5, 5)
    assert splits.read_cutoffs({"temporal_cutoffs": {"T_val_seconds": 1, "T_test_seconds": 2}}) == splits.Cutoffs(1, 2)
    with pytest.raises(ValueError, match="cutoffs"):
        splits.read_cutoffs({})


def test_leaks(spark):
    df = simple(spark, [(0, 250, 1)])
    with pytest.raises(ValueError, match="Data leak"):
        splits.leak_check(df, 100)
    assert splits.leaked(df, df).count() == 1


def test_nested_samples(spark):
    users = spark.range(2000).withColumnRenamed("id", "uid")
    big, small = splits.nested_users(users, (0.10, 0.01), 15, 42)
    assert big.count() == 200 and small.count() == 20 and splits.strangers(small, big, "uid").isEmpty()
    with pytest.raises(ValueError):
        splits.nested_users(users.limit(50), (0.10, 0.01), 100, 42)
    assert splits.sample_size(25, 0.1, 1) == 2 and splits.sample_size(35, 0.1, 1) == 4
    items = spark.range(50).withColumnRenamed("id", "item_id").withColumn("w", F.col("item_id") + 1.0)
    assert splits.weighted_sample(items, F.col("w"), 80, 1).count() == 50 and splits.anchors(items, 5, 1).distinct().count() == 5


def test_dense_ids(spark):
    items = spark.createDataFrame([(x,) for x in [7, 7, -3, 10**12, 5, 10**12 + 1]], "item_id long")
    ids = splits.dense_ids(items)
    assert sorted((r.dense_id, r.raw_id) for r in ids.collect()) == [(0, -3), (1, 5), (2, 7), (3, 10**12), (4, 10**12 + 1)]
    assert splits.check_dense(ids) and not splits.check_dense(ids.filter("dense_id <> 2"))
    assert splits.to_raw(splits.to_dense(items, ids).select("dense_id"), ids).count() == 6
    with pytest.raises(KeyError, match="99"):
        splits.to_dense(spark.createDataFrame([(99,)], "item_id long"), ids)


def test_profile(spark):
    counts = spark.createDataFrame([(x,) for x in [1, 1, 2, 4, 8]], "count long")
    x = np.array([1, 1, 2, 4, 8])
    want = 2 * (np.arange(1, 6) * x).sum() / (5 * x.sum()) - 6 / 5
    assert profile.gini(counts, "count").first()[0] == pytest.approx(want)
    assert profile.gini(counts.limit(0), "count").first()[0] == 0
    assert profile.head_share(counts, "count", 0.21).first()[0] == pytest.approx(12 / 16)
    weeks = profile.weekly(simple(spark, [(1, 100, 1), (2, 100 + 7 * DAY, 1), (2, 100 + 7 * DAY, 2), (3, 100 + 21 * DAY, 1)]))
    assert sorted(map(tuple, weeks.collect())) == [(0, 1, 1), (1, 2, 1), (3, 1, 1)]
    assert profile.trend(weeks).first()["label"] == "flat" and profile.trend(weeks.filter("week < 2")).first()["label"] == "rising"
    bins = {r.bin: r["count"] for r in profile.histogram(spark.createDataFrame([(v,) for v in [0.0, 0.5, 1.0, 1.1]], "v double"), "v", 0, 1, 2).collect()}
    assert bins == {0: 1, 1: 2}
    lengths = spark.range(100).withColumn("length", F.col("id"))
    assert profile.group_bounds(lengths, "length", 20) == (25, 74)
    with pytest.raises(ValueError):
        profile.group_bounds(lengths, "length", 60)
    runs = spark.createDataFrame([("m", 1, "r", 10, 0.1), ("m", 2, "r", 10, 0.3), ("n", 1, "r", 10, 0.5), ("n", 2, "r", 10, None)], "model string, seed int, metric string, k int, value double")
    got = {r.model: (r["mean"], r["std"]) for r in profile.over_seeds(runs).collect()}
    assert got["m"] == pytest.approx((0.2, math.sqrt(0.02))) and got["n"] == (0.5, 0.0)
    assert profile.seed_table(runs, ["m", "n"]).columns == ["metric", "k", "m_mean", "m_std", "n_mean", "n_std"]
    assert profile.flatten({"a": {"b": 1, "c": "x"}, "d": 2.5}) == {"a/b": 1.0, "d": 2.5}
    assert profile.same_magnitude(5, 10) and not profile.same_magnitude(500, 10)


def test_ranks_by_ranges(spark):
    from tidemark.operators import order

    rng = random.Random(5)
    rows = [(rng.choice([rng.random(), float(rng.randrange(5)), 1e12 * rng.random()]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, i long").repartition(8)
    got = {r.i: r.before for r in order.with_before(df, ["x", "i"]).collect()}
    assert [got[i] for _, i in sorted(rows)] == list(range(3000))
    shares = (0.0, 0.01, 0.25, 0.5, 0.973, 1.0)
    assert order.percentiles(df, "x", shares).first().p == pytest.approx(np.quantile([x for x, _ in rows], shares).tolist())
    assert order.percentiles(df.limit(0), "x", shares).first().p == [None] * 6 and order.with_before(df.limit(0), ["x"]).count() == 0
    recorded = {"rows": 2, "users": 2, "items": 1}
    now = profile.counts(simple(spark, [(1, 5, 1), (2, 6, 1)]))
    profile.check_drift(now, recorded)
    with pytest.raises(ValueError, match="items: 4 recorded, 1 found"):
        profile.check_drift(now, recorded | {"items": 4})
    assert [tuple(r) for r in schema.problems(spark.createDataFrame([(1, None)], "uid long, timestamp int"), T.StructType([T.StructField("uid", T.LongType()), T.StructField("timestamp", T.LongType()), T.StructField("item_id", T.LongType())])).orderBy("column", "problem").collect()] == [
        ("item_id", "missing", ""), ("timestamp", "nulls", "1"), ("timestamp", "type", "int")]


def test_metrics_micro_cases(spark):
    lists = {1: [5, 7, 9, 1]}
    assert value(spark, lists, {1: [5, 7, 9]}, "ndcg@3") == pytest.approx(1) and value(spark, {1: [7, 5, 9, 1]}, {1: [5, 7, 9]}, "ndcg@4") == pytest.approx(1)
    assert value(spark, lists, {1: [7]}, "ndcg@2") == pytest.approx(1 / math.log2(3))
    two = {1: [5, 7, 9, 1], 2: [5, 7, 9, 1]}
    assert value(spark, two, {1: [7], 2: [99]}, "hitrate@2") == value(spark, two, {1: [7], 2: [99]}, "hitrate@4") == 0.5
    wide = {1: list(range(10)), 2: list(range(10))}
    assert value(spark, wide, {1: [0, 1, 2, 3, 4], 2: list(range(100, 120))}, "recall@10") == 0.5
    assert value(spark, {1: [0, 1, 2], 2: [0, 1, 4]}, {1: [0]}, "coverage@3") == 0.04
    assert value(spark, {1: [1, 2, 3]}, {1: [1, 3]}, "dcg@3") == 1.5
    assert value(spark, lists, {1: [9]}, "mrr@4") == pytest.approx(1 / 3) and value(spark, lists, {1: [9]}, "mrr@2") == 0
    assert value(spark, lists, {1: [9, 9, 9]}, "precision@4") == 0.25
    users = {r.uid: r.recall_2 for r in metrics.per_user(ranked(spark, two), targets(spark, {1: [5, 7], 2: [9]}), ["recall@2"]).collect()}
    assert users == {1: 1.0, 2: 0.0}
    with pytest.raises(KeyError):
        metrics.parse(["nope@3"])
    with pytest.raises(Exception, match="beyond"):
        value(spark, lists, {1: [7]}, "recall@9")
    with pytest.raises(Exception, match="no ranking"):
        value(spark, lists, {3: [7]}, "recall@2")


def test_ranking(spark):
    rng = np.random.default_rng(0)
    make = lambda n, name, ints=False: spark.createDataFrame([(i, [float(x) for x in (rng.integers(-2, 3, 6) if ints else rng.normal(size=6))]) for i in range(n)], f"{name} long, vec array<double>")
    for ints in (False, True):
        users, items = make(40, "uid", ints), make(60, "item_id", ints)
        a = sorted((r.uid, r.rank, r.item_id) for r in ranking.rank_blocks(users, items, 7).collect())
        assert a == sorted((r.uid, r.rank, r.item_id) for r in ranking.rank_blocks(users, items, 7, item_bytes=500, user_rows=9).collect())
        u, v = ({r[0]: np.array(r[1]) for r in df.collect()} for df in (users, items))
        scores = {x: sorted(v, key=lambda i: (-round(float(u[x] @ v[i]), 9), i))[:7] for x in u}
        assert [i for _, _, i in a] == [i for x in sorted(u) for i in scores[x]]
    flat = items.withColumn("vec", F.array(*[F.lit(1.0)] * 6))
    assert [r.item_id for r in ranking.rank_blocks(users.limit(1), flat, 60).orderBy("rank").collect()] == list(range(60))
    with pytest.raises(ValueError):
        ranking.rank_blocks(users, items, 61)


def test_ranking_of_equal_vectors_and_parts(spark):
    rng = np.random.default_rng(1)
    kinds = [[0.0, 0.0], [1.0, 0.0], [0.0, -0.0], [1e-12, 0.0], [0.5, 0.25]]
    x = {i: kinds[rng.integers(5)] if i % 3 else [float(v) for v in rng.normal(size=2)] for i in range(90)}
    u = {i: kinds[rng.integers(5)] if i % 2 else [float(v) for v in rng.normal(size=2)] for i in range(30)}
    users, items = spark.createDataFrame(list(u.items()), "uid long, vec array<double>"), spark.createDataFrame(list(x.items()), "item_id long, vec array<double>")
    want = {(i, r, j) for i in u for r, j in enumerate(sorted(x, key=lambda j: (-round(float(np.dot(u[i], x[j])), 10), j))[:40], 1)}
    for sizes in ({}, {"item_bytes": 64, "user_rows": 3}, {"item_bytes": 64, "part_bytes": 1_000, "part_users": 7}):
        assert {(r.uid, r.rank, r.item_id) for r in ranking.rank_blocks(users, items, 40, **sizes).collect()} == want
    with pytest.raises(Exception, match="finite"):
        ranking.rank_blocks(users, items.withColumn("vec", F.array(F.lit(1.0), F.lit(float("nan")))), 5).collect()


def _shuffled(spark) -> int:
    """Shuffle records written by the session so far."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_ranking_of_cells_repeats_no_vectors(spark):
    rng = np.random.default_rng(4)
    kinds = [[0.0, 0.0], [1.0, 0.0], [0.0, -0.0], [1e-12, 0.0], [0.5, 0.25]]
    x = {i: kinds[rng.integers(5)] if i % 3 else [float(v) for v in rng.normal(size=2)] for i in range(90)}
    u = {i: kinds[rng.integers(5)] if i % 2 else [float(v) for v in rng.normal(size=2)] for i in range(30)}
    users, items = spark.createDataFrame(list(u.items()), "uid long, vec array<double>"), spark.createDataFrame(list(x.items()), "item_id long, vec array<double>")
    for k, cell in ((40, 200), (3, 500), (90, 1 << 20)):
        want = {(i, r, j) for i in u for r, j in enumerate(sorted(x, key=lambda j: (-round(float(np.dot(u[i], x[j])), 10), j))[:k], 1)}
        got = ranking.rank_blocks(users, items, k, item_bytes=64, user_rows=7, repeated=0, cell=cell).collect()
        assert {(r.uid, r.rank, r.item_id) for r in got} == want and len(got) == len(want)
    with pytest.raises(Exception, match="finite"):
        ranking.rank_blocks(users, items.withColumn("vec", F.array(F.lit(1.0), F.lit(float("nan")))), 5, repeated=0).collect()
    singles = items.withColumn("vec", F.col("vec").cast("array<float>"))
    assert sorted(map(tuple, ranking.rank_blocks(users, singles, 5, repeated=0).collect())) == sorted(map(tuple, ranking.rank_blocks(users, singles, 5).collect()))
    many = spark.range(2_000).select(F.col("id").alias("item_id"), F.array(*[F.rand(j) for j in range(4)]).alias("vec")).localCheckpoint()
    before = _shuffled(spark)
    ranking.rank_blocks(many.limit(1_000).withColumnRenamed("item_id", "uid"), many, 1, part_bytes=3_200, part_users=50, repeated=0, cell=3_200).collect()
    assert _shuffled(spark) - before < 16_000  # 1,000 users and 2,000 items once or twice, and the best of each partition; the grid of 40 parts by 20 repeats 80,000


def test_cleaning_moves_heard_rows_once(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40) if i % 50 else 1000 + i, rng.randrange(30) if i % 70 else 1000 + i, rng.randrange(60), 1, rng.choice([10, 20, 49, 50, 90]), rng.randrange(3)) for i in range(20_000)]
    df = log(spark, rows).localCheckpoint()
    heard = cleaning.played(cleaning.key_dedup(cleaning.exact_dedup(df)), 50)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of a real size
    try:
        before = _shuffled(spark)
        got = sorted(map(tuple, cleaning.clean(df, 50, 5, 5).collect()))
        moved = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = {tuple(r) for r in heard.collect()}
    while True:
        users, items = (Counter(r[c] for r in want) for c in (0, 1))
        left = {r for r in want if users[r[0]] >= 5 and items[r[1]] >= 5}
        if left == want:
            break
        want = left
    assert got == sorted(want) and moved < len(rows)


def test_small_blocks_move_no_more_rows(spark):
    items = spark.range(3_000).select(F.col("id").alias("item_id"), F.array(*[F.rand(j) for j in range(4)]).alias("vec")).localCheckpoint()
    moved = []
    for sizes in ({}, {"item_bytes": 320, "user_rows": 20}):
        before = _shuffled(spark)
        ranking.rank_blocks(items.withColumnRenamed("item_id", "uid"), items, 5, **sizes).collect()
        moved.append(_shuffled(spark) - before)
    assert 0 < moved[1] <= moved[0]


def test_scores_of_few_pairs_are_in_memory_at_once():
    x = np.random.default_rng(0).normal(size=(200_000, 2))
    tracemalloc.start()
    ranking.best_items(np.arange(512), x[:512], np.arange(len(x)), x, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # a row of scores for each of 128 users would take 200 MB


def test_baselines(spark):
    users = spark.createDataFrame([(1,), (2,)], "uid long")
    pop = lambda xs: spark.createDataFrame(list(enumerate(xs)), "item_id long, popularity long")
    top = lambda xs, k: [[r.item_id for r in ranking.rank_popular(pop(xs), users, k).filter(F.col("uid") == u).orderBy("rank").collect()] for u in (1, 2)]
    assert top([10, 50, 5, 30, 20], 3) == [[1, 3, 4]] * 2 and top([7, 7, 7, 3], 3) == [[0, 1, 2]] * 2
    assert top([20_000_000, 20_000_001, 20_000_002], 3) == [[2, 1, 0]] * 2
    with pytest.raises(Exception, match="smaller catalogue"):
        top([1, 2, 3], 4)
    many = spark.range(300).withColumnRenamed("id", "uid")
    for n in (10, 12, 200):
        rows = ranking.rank_random(many, n, 10, 7).collect()
        by = {}
        for r in rows:
            by.setdefault(r.uid, []).append(r.item_id)
        assert len(by) == 300 and all(len(set(x)) == 10 and 0 <= min(x) and max(x) < n for x in by.values())
        assert sorted(map(tuple, rows)) == sorted(map(tuple, ranking.rank_random(many.repartition(5), n, 10, 7).collect()))
        hits = np.bincount([i for x in by.values() for i in x], minlength=n)
        assert abs(hits - 3000 / n).max() < 6 * math.sqrt(3000 / n)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [6.0, 8.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, None)], "item_id long, vec array<double>")
    assert {r.item_id for r in vectors.bad_vectors(df, 2).collect()} == {4, 5, 6}
    good = df.filter("item_id < 4")
    assert [list(r.v) for r in good.select("item_id", vectors.normalised(F.col("vec")).alias("v")).orderBy("item_id").collect()] == [[0.6, 0.8], [0, 0], [0.6, 0.8]]
    assert vectors.norm_stats(good).first()["max"] == 10
    near = vectors.cosine_neighbours(good.filter("item_id = 1"), good, 2).orderBy("rank").collect()
    assert [(r.neighbour, r.score) for r in near] == [(3, 1.0), (2, 0.0)]
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0.1] + 100
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vec array<double>")
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert [r.share for r in vectors.principal_variance(frame, 2).orderBy("component").collect()] == pytest.approx((s / s.sum())[:2])
    pc = np.array([r.pc for r in vectors.principal(frame, 2).orderBy("item_id").collect()])
    assert abs(pc.mean(0)).max() < 1e-8
    with pytest.raises(ValueError):
        vectors.lookup(good, spark.createDataFrame([(77,)], "item_id long"))
    with pytest.raises(ValueError):
        tables.vector_column(good)


def test_sequences(spark):
    rows = simple(spark, [(0, 30, 12), (0, 10, 10), (1, 5, 14), (0, 20, 11), (1, 4, 13)])
    ids = splits.dense_ids(rows)
    seqs = sequences.sequences(rows, ids)
    assert {r.uid: r["items"] for r in seqs.collect()} == {0: [0, 1, 2], 1: [3, 4]}
    pairs = {r.uid: (r["items"], r.positives) for r in sequences.next_items(seqs, 1).collect()}
    assert pairs == {0: ([1], [2]), 1: ([3], [4])}
    assert {r.uid: r["items"] for r in sequences.eval_state(seqs, 2).collect()} == {0: [1, 2], 1: [3, 4]}
    pad = {r.uid: (r.padded, r.mask, r.positions) for r in sequences.padded(seqs, 3).collect()}
    assert pad[1] == ([3, 4, 0], [True, True, False], [1, 0, 0])
    assert sequences.flattened(seqs).count() == 5
    with pytest.raises(ValueError):
        sequences.prefixes(rows, rows, ids, "train", 10)
    with pytest.raises(ValueError, match="Data leak"):
        sequences.prefixes(rows, rows, ids, "val", 10)
    assert {r.uid: r["items"] for r in sequences.grouped_items(rows.union(rows)).collect()}[0] == [10, 11, 12]


def test_significance(spark):
    pairs = spark.createDataFrame([(1.0, 0.0), (3.0, 1.0), (0.0, 3.0), (5.0, 1.0), (2.0, 2.0), (9.0, 8.0)], "a double, b double")
    row = significance.wilcoxon(pairs).first()
    assert row.n == 5 and row.w == 4.0 and 0 < row.p <= 1
    assert tuple(significance.wilcoxon(pairs.filter("a = b")).first()) == (0, 0.0, 1.0)
    tests = spark.createDataFrame([(0.01,), (0.03,)], "p double")
    assert [r.significant for r in significance.bonferroni(tests).orderBy("p").collect()] == [True, False]
    ci = significance.bootstrap_mean(spark.range(200).select("id", F.col("id").cast("double").alias("x")), 200, 3).first()
    assert ci["mean"] == 99.5 and ci.low < 99.5 < ci.high and 80 < ci.low and ci.high < 120
    lengths = spark.range(10).select(F.col("id").alias("uid"), (F.col("id") % 3).alias("length"), F.lit(1.0).alias("m"))
    assert sorted(r.users for r in significance.by_history(lengths.select("uid", "m"), lengths, "m").collect()) == [2, 2, 3, 3]


def encoder(rng, n_items=9, d=8, longest=6, heads=2):
    g = lambda *s: rng.normal(0, 0.3, s)
    norm = lambda: (1 + g(d), g(d))
    layer = lambda: neural.Layer(g(3 * d, d), g(3 * d), g(d, d), g(d), g(16, d), g(16), g(d, 16), g(d), norm(), norm())
    return g(n_items, d), neural.Encoder(g(longest, d), norm(), (layer(), layer()), heads)


def slow_hidden(model, items, seq):
    """The encoder by loops over positions and heads."""
    def norm(x, p):
        return (x - x.mean()) / math.sqrt(((x - x.mean()) ** 2).mean() + model.eps) * p[0] + p[1]

    d = items.shape[1]
    w = d // model.heads
    xs = [norm(items[i] + model.positions[len(seq) - 1 - p], model.norm) for p, i in enumerate(seq)]
    for layer in model.layers:
        made = [np.split(layer.in_weight @ x + layer.in_bias, 3) for x in xs]
        out = []
        for p, x in enumerate(xs):
            heads = []
            for h in range(model.heads):
                part = slice(h * w, (h + 1) * w)
                e = np.array([math.exp(made[p][0][part] @ made[r][1][part] / math.sqrt(w)) for r in range(p + 1)])
                heads.append(sum(c * made[r][2][part] for r, c in enumerate(e / e.sum())))
            x = norm(x + layer.out_weight @ np.concatenate(heads) + layer.out_bias, layer.norm1)
            up = layer.up_weight @ x + layer.up_bias
            up = np.array([v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in up])
            out.append(norm(x + layer.down_weight @ up + layer.down_bias, layer.norm2))
        xs = out
    return xs


def test_encoder_equals_loops_and_is_causal(spark, tmp_path):
    rng = np.random.default_rng(3)
    items, model = encoder(rng)
    grid = np.linspace(-6, 6, 2001)
    assert np.abs(neural.erf(grid) - [math.erf(v) for v in grid]).max() < 1.5e-7
    seqs = {u: rng.integers(0, 9, u % 7).tolist() for u in range(150)}
    seqs[200] = rng.integers(0, 9, 20).tolist()
    frame = spark.createDataFrame(list(seqs.items()), "uid long, items array<long>")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "dense_id long, vec array<double>")
    got = {r.uid: r.vec for r in neural.user_vectors(frame, table, model).collect()}
    assert set(got) == set(seqs) and got[0] == [0.0] * 8
    for u, s in seqs.items():
        if s:
            assert np.allclose(got[u], slow_hidden(model, items, s[-6:])[-1], atol=1e-5)
    seq = np.array([[1, 4, 2, 7], [1, 4, 2, 8]])
    full = neural.hidden_states(model, items[seq], np.array([4, 4]))
    assert np.allclose(full[0, :3], full[1, :3]) and not np.allclose(full[0, 3], full[1, 3])
    with pytest.raises(Exception, match="no vector"):
        neural.user_vectors(frame, table.limit(3), model).collect()
    goal = spark.createDataFrame([(u, int(u) % 9) for u in (3, 4, 5)], "uid long, item_id long")
    scores, users = neural.evaluate(frame, table, model, goal, ["recall@2", "hitrate@2", "coverage@2"])
    want = [int(u % 9 in np.lexsort((np.arange(9), -np.round(items @ got[u], 10)))[:2]) for u in (3, 4, 5)]
    assert {r.metric: r.value for r in scores.collect()}["recall"] == pytest.approx(np.mean(want)) and [r.recall_2 for r in users.orderBy("uid").collect()] == want
    neural.extract({"val": frame, "test": frame.limit(0)}, table, model, f"{tmp_path}/v")
    back = {r.uid: r.vec for r in sinks.read_vectors(spark, f"{tmp_path}/v", "val").collect()}
    assert np.allclose(back[200], got[200], atol=1e-6) and sinks.read_vectors(spark, f"{tmp_path}/v", "items").count() == 9 and sinks.read_vectors(spark, f"{tmp_path}/v", "test").count() == 0
    unit = neural.content_items(rng.normal(size=(4, 5)), rng.normal(size=(8, 5)), np.zeros(8))
    assert np.allclose(np.linalg.norm(unit, axis=1), 1)


def test_log_q_and_loss(spark):
    pop = spark.range(50).select(F.col("id").alias("dense_id"), F.lit(4).cast("long").alias("popularity"))
    assert all(r.log_q == pytest.approx(-math.log(50)) for r in neural.log_q(pop).collect())
    with pytest.raises(ValueError):
        neural.log_q(pop.withColumn("popularity", F.lit(0)))
    rng = np.random.default_rng(4)
    q, items = rng.normal(size=(5, 4)), rng.normal(size=(20, 4))
    users, pos, uni = np.array([0, 0, 1, 1, 2]), np.array([1, 2, 3, 4, 5]), np.array([7, 8])
    logq = np.log(np.full(20, 1 / 20))
    want = []
    for a in range(5):
        logits = [q[a] @ items[pos[a]]] + [q[a] @ items[pos[b]] - logq[pos[b]] for b in range(5) if users[b] != users[a]] + [q[a] @ items[u] + math.log(20) for u in uni]
        want.append(-logits[0] + math.log(sum(map(math.exp, logits))))
    assert neural.sampled_softmax(q, users, pos, items, logq, uni, 0.0) == pytest.approx(np.mean(want))
    flat = spark.range(30).select(F.col("id").alias("uid"), F.lit(0).alias("pos"))
    assert neural.capped_positions(flat, 7, 1).count() == 7 and neural.capped_positions(flat, 0, 1).count() == 30


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "item_id long, vec array<double>")
    path = shared_dir(spark)
    sinks.write_parquet(df, f"{path}/t")
    sinks.write_parquet(df.union(df), f"{path}/t")
    assert spark.read.parquet(f"{path}/t").count() == 2
    assert not sinks.export_splits({"train": df}, f"{path}/x", dry_run=True) is None
    sinks.export_splits({"train": df, "extra": df}, f"{path}/x", {"seed": 1})
    with pytest.warns(UserWarning, match="extra"):
        assert sinks.import_splits(spark, f"{path}/x", ["train"])["train"].count() == 1
    with pytest.raises(ValueError, match="missing splits"):
        sinks.import_splits(spark, f"{path}/x", ["val"])
    sinks.verify_export(df, ["item_id"], "vec", 2)
    with pytest.raises(ValueError):
        sinks.verify_export(df, ["item_id"], "vec", 3)
    js = tmp_path / "a" / "m.json"
    sinks.update_section(js, "one", {"x": np.float64(1.5), "p": tmp_path, "n": float("nan")})
    sinks.update_section(js, "two", np.arange(3))
    assert sinks.read_json(js) == {"one": {"x": 1.5, "p": str(tmp_path), "n": None}, "two": [0, 1, 2]}
    assert "| 1 |" in sinks.markdown("Report", {"t": df.select("item_id")})
    sinks.write_csv(df.select("item_id"), f"{path}/csv")
    assert spark.read.option("header", True).csv(f"{path}/csv").first()["item_id"] == "1"


def test_tables_belong_to_their_owners(spark):
    import threading

    from tidemark.plans.prepare import forget, prepare
    from tidemark.sources.work import Scratch, materialise, owning, release

    sf = "/root/testdata/sf0.001"
    loose = materialise(spark.range(5).toDF("x"))
    n = prepare(spark, sf).train.count() if os.path.isdir(sf) else 0
    with Scratch(spark) as tables, owning(tables):
        mine = materialise(spark.range(3).toDF("x"))
        other = []
        t = threading.Thread(target=lambda: other.append(materialise(spark.range(7).toDF("x"))))
        t.start()
        t.join()
        assert mine.count() == 3
    with pytest.raises(Exception):  # noqa: B017 - the file is gone
        mine.count()
    release(spark)
    with pytest.raises(Exception):  # noqa: B017
        loose.count()
    assert other[0].count() == 7  # another thread's
    if n:
        assert prepare(spark, sf).train.count() == n
        held = prepare(spark, sf).train
        forget()
        with pytest.raises(Exception):  # noqa: B017
            held.count()
        assert prepare(spark, sf).train.count() == n
