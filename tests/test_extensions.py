"""Codes, neighbours, moments and factors on small hand-made tables, against loops and numpy."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import codes, factors, moments, neighbours
from tidemark.operators.skew import hot_keys, salted_join
from tidemark.operators.vectors import normalised

LOG = "uid long, item_id long, timestamp long"


def log_rows(rng, users=30, items=40, n=600, last=5_000_000):
    rows = [(int(rng.integers(0, users)), int(items * rng.random() ** 2), int(rng.integers(0, last))) for _ in range(n)]
    rows += [(0, i, 7) for i in range(items)] + [(u, 1, 9) for u in range(users)]  # a heavy user and a hot item, times alike
    return rows + rows[:5]


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables stay in as many ranges as large ones have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def log(spark):
    rows = log_rows(np.random.default_rng(1))
    return rows, spark.createDataFrame(rows, LOG).repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(35)]
    return dict(rows), spark.createDataFrame(rows, "item_id long, vec array<float>")


def grid(v):
    return np.floor(np.array(v, np.float64) * codes.GRID + 0.5).astype(int)


def test_salted_join_is_a_join(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (3, "d")], "k long, x string")
    small = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "k long, y long")
    for how in ("inner", "left"):
        assert sorted(map(tuple, salted_join(rows, small, ["k"], how).collect()), key=str) == sorted(map(tuple, rows.join(small, "k", how).collect()), key=str)


def test_codes_are_nearest_and_errors_fall(spark, items):
    vecs, df = items
    on = df.select("item_id", codes.on_grid(F.col("vec")).alias("v")).repartition(3)
    books = codes.learn(on, 3, 4, 3, 7)
    got = {r.item_id: r for r in codes.encode(on, books).collect()}
    before = float("inf")
    left = {i: grid(v) for i, v in vecs.items()}
    for level, book in enumerate(books):
        for i, x in left.items():
            away = ((x - book) ** 2).sum(1)
            assert got[i].codes[level] == int(away.argmin()) and got[i].residual[level] == int(away.min())
            left[i] = x - book[got[i].codes[level]].astype(int)
        total = sum(r.residual[level] for r in got.values())
        assert total < before
        before = total
    report = {r.level: r for r in codes.level_report(codes.encode(on, books), 4).collect()}
    assert report[2].used == len({r.codes[1] for r in got.values()}) and report[2].share == report[2].used / 4
    assert all((a == b).all() for a, b in zip(books, codes.learn(on.repartition(7), 3, 4, 3, 7), strict=True))  # however rows are dealt
    empty = codes.encode(on.limit(0), codes.learn(on.limit(0), 2, 4, 2, 7))
    assert empty.collect() == []
    few = on.limit(2)
    assert all(r.residual[0] == 0 for r in codes.encode(few, codes.learn(few, 2, 4, 2, 7)).collect())


def test_pooled_and_cut_histories(log, items):
    rows, df = log
    vecs, vdf = items
    mean = lambda got: [int(x) // len(got) for x in np.sum([grid(vecs[i]) for i in got], 0)]
    by_user = defaultdict(list)
    for u, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if i in vecs:
            by_user[u].append(i)
    assert {r.uid: r.v for r in codes.pooled(df, vdf).collect()} == {u: mean(x) for u, x in by_user.items()}
    cuts = {(r.uid, r.cut): r.v for r in codes.history_cuts(df, vdf, (50, 100)).collect()}
    assert cuts == {(u, c): mean(x[: -(-c * len(x) // 100)]) for u, x in by_user.items() for c in (50, 100)}


def test_cut_histories_are_numbered_without_vectors(log, items, monkeypatch):
    seen = []
    monkeypatch.setattr(codes, "with_before", lambda rows, keys, _real=codes.with_before: seen.append(rows.columns) or _real(rows, keys))
    codes.history_cuts(log[1], items[1], (50, 100))
    assert [sorted(columns) for columns in seen] == [["item_id", "timestamp", "uid"]]


def test_stability(spark):
    rows = [(1, 70, [1, 2]), (1, 100, [1, 3]), (2, 70, [0, 0]), (2, 100, [0, 0])]
    df = spark.createDataFrame([(u, c, x, [0, 0]) for u, c, x in rows], "uid long, cut int, codes array<int>, residual array<long>")
    assert {(r.cut, r.level): (r.users, r.equal, r.share) for r in codes.stability(df).collect()} == {(70, 1): (2, 2, 1.0), (70, 2): (2, 1, 0.5), (100, 1): (2, 2, 1.0), (100, 2): (2, 2, 1.0)}


def test_code_lists_fall_back(spark, log):
    rows, df = log
    rng = random.Random(4)
    of = {u: [rng.randrange(2), rng.randrange(3), rng.randrange(3)] for u in range(30)}
    of[29] = [9, 9, 9]
    coded = spark.createDataFrame(list(of.items()), "uid long, codes array<int>")
    lists = codes.code_lists(df, coded, coded.filter("uid >= 20"), 3, 4, least=5)
    got = defaultdict(list)
    for r in sorted(lists.collect(), key=lambda r: (r.uid, r.level, r.rank)):
        got[r.uid, r.level, r.used_level].append((r.item_id, r.score))
    slow = {}
    for u in range(20, 30):
        for level in (1, 2, 3):
            used = next(n for n in range(level, -1, -1) if n == 0 or sum(c[:n] == of[u][:n] for c in of.values()) >= 5)
            n = Counter(i for v, i, _ in rows if of[v][:used] == of[u][:used])
            slow[u, level, used] = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert dict(got) == slow
    share = {r.level: r.backed_off for r in codes.back_offs(lists).collect()}
    assert share == {n: sum(1 for _, level, used in slow if level == n and used < n) for n in (1, 2, 3)} and slow[29, 3, 0]


def test_permuted_codes_are_a_permutation(spark):
    coded = spark.createDataFrame([(u, [u // 3, u]) for u in range(100)], "uid long, codes array<int>")
    one = sorted((r.uid, r.codes) for r in codes.permuted(coded, 3).collect())
    assert one == sorted((r.uid, r.codes) for r in codes.permuted(coded.repartition(9), 3).collect())
    assert sorted(c for _, c in one) == [[u // 3, u] for u in range(100)] and sum(c[1] == u for u, c in one) < 10
    assert one != sorted((r.uid, r.codes) for r in codes.permuted(coded, 4).collect())


def test_item_neighbours_equal_loops(spark, log):
    rows, df = log
    of = defaultdict(set)
    for u, i, _ in rows:
        of[i].add(u)
    slow = {}
    for a in of:
        found = sorted(((-round(len(of[a] & of[b]) / (len(of[a]) * len(of[b])) ** 0.5, 10), b) for b in of if b != a and of[a] & of[b]))[:5]
        slow[a] = [(b, -s) for s, b in found]
    nulls = df.unionByName(df.limit(3).withColumn("item_id", F.lit(None).cast("long")))
    for segment in (4, 256):  # a user's items in many segments, or in one
        got = defaultdict(list)
        for r in sorted(neighbours.item_neighbours(nulls, 5, segment).collect(), key=lambda r: (r.item_id, r.rank)):
            got[r.item_id].append((r.neighbour, r.score))
        assert dict(got) == slow
    assert neighbours.item_neighbours(df.limit(0), 5).collect() == []
    knn = neighbours.item_neighbours(df, 5)
    have = defaultdict(set)
    for u, i, _ in rows:
        have[u].add(i)
    lists = {(r.uid, r.rank): (r.item_id, r.score) for r in neighbours.item_lists(df, df.filter("uid < 5"), knn, 3).collect()}
    for u in range(5):
        n = Counter()
        for i in have[u]:
            for b, s in slow[i]:
                n[b] += round(s * neighbours.STEPS)
        best = sorted(((-s, b) for b, s in n.items() if b not in have[u]))[:3]
        assert [lists.get((u, k)) for k in range(1, len(best) + 1)] == [(b, -s) for s, b in best] and (u, len(best) + 1) not in lists


@pytest.mark.parametrize("how", ["inner", "left"])
def test_only_hot_keys_are_dealt(spark, how):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 40 + [2] * 5 + [3] * 41 + [None] * 50 + [9])], "k int, i int")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (4, "e"), (None, "f")], "k int, x string")
    hot = hot_keys(rows, ["k"], 40, 1)
    assert sorted(r.k for r in hot.collect()) == [1, 3]
    for some in (hot, hot.limit(0)):
        assert sorted(map(tuple, salted_join(rows, small, ["k"], how, hot=some).collect()), key=str) == sorted(map(tuple, rows.join(small, "k", how).collect()), key=str)


def test_user_neighbours_leave_out_oneself(spark, log):
    rows, df = log
    rng = np.random.default_rng(3)
    vecs = {u: rng.normal(size=4).tolist() for u in range(25)} | {u: [1.0, 1.0, 0.0, 0.0] for u in range(25, 30)}  # ties with oneself
    users = spark.createDataFrame(list(vecs.items()), "uid long, vec array<double>").repartition(3)
    got = defaultdict(list)
    for r in sorted(neighbours.user_neighbours(users, users, 3).collect(), key=lambda r: (r.uid, r.rank)):
        got[r.uid].append((r.neighbour, r.score))
    unit = {u: np.array(v) / np.linalg.norm(v) for u, v in vecs.items()}
    for u in vecs:
        slow = sorted((-round(float(unit[u] @ unit[v]), 10), v) for v in vecs if v != u)[:3]
        assert [v for v, _ in got[u]] == [v for _, v in slow] and np.allclose([s for _, s in got[u]], [-s for s, _ in slow])
    near = neighbours.user_neighbours(users, users, 3)
    have = defaultdict(set)
    for u, i, _ in rows:
        have[u].add(i)
    lists = {(r.uid, r.rank): (r.item_id, r.score) for r in neighbours.neighbour_lists(df, near, 4).collect()}
    n = Counter()
    for v, s in got[27]:
        for i in have[v]:
            n[i] += round(s * neighbours.STEPS)
    assert [lists[27, k] for k in range(1, 5)] == sorted(n.items(), key=lambda x: (-x[1], x[0]))[:4]
    one = users.filter("uid = 3")
    assert neighbours.user_neighbours(one, one, 3).collect() == [] and neighbours.user_neighbours(one, users.limit(0), 3).collect() == []


def test_equal_users_are_compared_once(spark, monkeypatch):
    vecs = {u: [float(u % 3), 1.0, float(u % 2)] for u in range(60)}
    users = spark.createDataFrame(list(vecs.items()), "uid long, vec array<double>").repartition(3)
    sizes = []
    plain = neighbours.rank_blocks
    monkeypatch.setattr(neighbours, "rank_blocks", lambda u, i, k: sizes.append((u.count(), i.count())) or plain(u, i, k))
    got = defaultdict(list)
    for r in sorted(neighbours.user_neighbours(users.filter("uid < 20"), users, 12).collect(), key=lambda r: (r.uid, r.rank)):
        got[r.uid].append(r.neighbour)
    unit = {u: np.array(v) / np.linalg.norm(v) for u, v in vecs.items()}
    assert sizes == [(6, 6)] and len(got) == 20
    for u in range(20):
        assert got[u] == [v for _, v in sorted((-round(float(unit[u] @ unit[v]), 10), v) for v in vecs if v != u)[:12]]


@pytest.mark.parametrize("half_life", [40.0, 3600.0, 86_400.0 * 30])
def test_decayed_popularity_equals_sums(spark, log, half_life):
    rows, df = log
    asked = [(i, t) for _, i, t in rows[:80]] + [(99, 5), (1, 0), (1, 10**9), (None, 4), (1, None)]
    got = moments.decayed_before(df, spark.createDataFrame(asked, "item_id long, timestamp long"), "item_id", half_life).collect()
    assert len(got) == len(asked)
    for r in got:
        slow = sum(2.0 ** (-(r.timestamp - t) / half_life) for _, i, t in rows if i == r.item_id and r.timestamp is not None and t < r.timestamp)
        assert abs(r.decayed - slow) <= 1e-9 * max(1.0, slow)


def test_decayed_popularity_deals_the_log_by_bucket_once(spark, log):
    asked = spark.createDataFrame([(0, 5)], "item_id long, timestamp long")
    plan = moments.decayed_before(log[1], asked, "item_id", 50.0)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2  # the rows asked for, and a row a bucket


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_equals_loops(spark, log, strict):
    rows, df = log
    left = [(u, t + d, n) for n, (u, _, t) in enumerate(rows[:200]) for d in (0, 1)] + [(77, 5, -1), (None, 5, -2), (0, None, -3), (0, 7, -4), (0, 8, -5)]
    ldf = spark.createDataFrame(left, "uid long, t long, n long")
    right = df.withColumnRenamed("timestamp", "t").unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None)], "uid long, item_id long, t long"))
    got = sorted(map(tuple, moments.as_of(ldf, right, ["uid"], "t", {"t": "last_t", "item_id": "last_item"}, strict).collect()), key=str)
    slow = []
    for u, t, n in left:
        found = [(s, i) for v, i, s in rows if u is not None and t is not None and v == u and (s < t if strict else s <= t)]
        slow.append((u, t, n, *(max(found) if found else (None, None))))
    assert got == sorted(slow, key=str)


def test_as_of_splits_a_hot_key(spark):
    events = spark.range(20_000).select(F.lit(1).cast("long").alias("uid"), (F.col("id") % 19_997).alias("timestamp"), F.col("id").alias("item_id"))
    out = moments.last_before(events, events, "uid", ["timestamp", "item_id"], "last_")
    assert out.filter((F.col("last_timestamp") == F.col("timestamp") - 1) | ((F.col("timestamp") == 0) & F.col("last_timestamp").isNull())).count() == 20_000
    assert len(out.inputFiles()) >= 8  # the ranges that it was written in


def test_factors_equal_numpy(spark, log):
    rows, df = log
    rank, alpha, penalty = 5, 10.0, 0.1
    users, items, costs = factors.factorise(df, rank, 3, alpha, penalty)
    assert costs == sorted(costs, reverse=True) and len(costs) == 3
    n = np.zeros((30, 41))
    for u, i, _ in rows:
        n[u, i] += 1
    there = sorted({i for _, i, _ in rows})
    n = n[:, there]
    y = {r.id: np.array(r.vec) for r in factors.start(spark.createDataFrame([(i,) for i in there], "id long"), rank, factors.SEED).collect()}
    y = np.array([y[i] for i in there])

    def half(n, y):
        return np.array([np.linalg.solve(y.T @ np.diag(1 + alpha * row) @ y + penalty * np.eye(rank), y.T @ ((1 + alpha * row) * (row > 0))) for row in n])

    for _ in range(3):
        x = half(n, y)
        y = half(n.T, x)
    got = {r.id: r.vec for r in users.collect()}
    assert np.allclose([got[u] for u in range(30)], x, atol=1e-8)
    got = {r.id: r.vec for r in items.collect()}
    assert np.allclose([got[i] for i in there], y, atol=1e-8)
    slow = ((1 + alpha * n) * ((n > 0) - x @ y.T) ** 2).sum() + penalty * ((x**2).sum() + (y**2).sum())
    assert abs(costs[-1] - slow) < 1e-6 * slow


def test_vectors_move_to_ids_that_are_not_hot(spark, log):
    pairs = log[1].dropna().groupBy("uid", "item_id").agg(F.count(F.lit(1)).alias("n"))
    start = factors.start(pairs.select(F.col("item_id").alias("id")).distinct(), 3, 1)
    solve = lambda hot: factors.solved(pairs, "uid", "item_id", start, 3, 10.0, 0.1, hot_mine=hot)
    plain, mixed = solve(None), solve(spark.createDataFrame([(0,), (3,)], "id long"))
    assert "RepartitionByExpression [__id" in plain._jdf.queryExecution().optimizedPlan().toString()
    other = {r.id: r for r in mixed.collect()}
    rows = plain.collect()
    assert len(rows) == len(other) > 2
    for r in rows:
        assert np.allclose([*r.vec, r.seen], [*other[r.id].vec, other[r.id].seen], atol=1e-9)


def test_normalised_zero_vector(spark):
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(normalised(F.col("v")).alias("v")).first().v == [0.0, 0.0]


def test_objective_comes_with_the_solution(spark, log, monkeypatch):
    df = log[1].unionByName(log[1].filter("uid < 3"))
    plain = factors.objective
    monkeypatch.setattr(factors, "objective", lambda *args: pytest.fail("joins the pairs again"))
    users, items, costs = factors.factorise(df, 3, 2)
    pairs = df.filter("uid IS NOT NULL AND item_id IS NOT NULL").groupBy("uid", "item_id").agg(F.count(F.lit(1)).alias("n"))
    assert costs[-1] == pytest.approx(plain(pairs, users, items, 3, factors.ALPHA, factors.PENALTY), rel=1e-9)
    assert users.columns == items.columns == ["id", "vec"]


def test_weekly_stream_equals_the_table(spark, tmp_path):
    from tidemark.config import WEEK
    from tidemark.operators.profile import weekly as table_weekly
    from tidemark.sources.tables import INTERACTIONS
    from tidemark.streaming import weekly

    rng = random.Random(9)
    rows = sorted((rng.randrange(1000, 1000 + 6 * WEEK), rng.randrange(20)) for _ in range(500))
    log = spark.createDataFrame([(u, 1, t, 0, 50, 9) for t, u in rows] + [(None, 1, rows[9][0], 0, 50, 9)], INTERACTIONS)
    origin, last = rows[0][0], rows[-1][0]
    source, sink, checkpoint = (str(tmp_path / x) for x in ("source", "sink", "checkpoint"))
    middle = origin + 3 * WEEK
    log.filter(F.col("timestamp") < middle).write.parquet(source)
    weekly.run(spark, source, sink, checkpoint, origin, 100)
    log.filter(F.col("timestamp") >= middle).write.mode("append").parquet(source)
    weekly.run(spark, source, sink, checkpoint, origin, 100)  # goes on where the first ended
    weekly.run(spark, source, sink, checkpoint, origin, 100)  # nothing new
    log.limit(7).write.mode("append").parquet(source)  # late
    weekly.close(spark, source, last, 100)
    weekly.run(spark, source, sink, checkpoint, origin, 100)
    out = spark.read.schema("week long, interactions long, active_users long").parquet(sink)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, table_weekly(log).collect()))
    assert sum(r.late for r in weekly.late_rows(spark, source, sink, origin).collect()) == 7


def test_versions_are_replaced_without_a_gap(spark, tmp_path):
    from tidemark.sources import sinks

    path = str(tmp_path / "table")
    with pytest.raises(ValueError, match="no version"):
        sinks.read_version(spark, path)
    assert sinks.write_version(spark.range(3), path) == 1
    held = sinks.read_version(spark, path)
    assert sinks.write_version(spark.range(5), path) == 2
    assert held.count() == 3 and sinks.read_version(spark, path).count() == 5  # a reader of the one before goes on
    (tmp_path / "table" / "pointers" / "000000000003").write_text("")  # another writer has the number but is not done
    assert sinks.read_version(spark, path).count() == 5
    assert sinks.write_version(spark.range(7), path) == 4
    assert sinks.read_version(spark, path).count() == 7 and sinks.read_version(spark, path, 2).count() == 5
    with pytest.raises(ValueError, match="no version 1"):
        sinks.read_version(spark, path, 1)


def test_invariants_are_one_job(spark):
    from tidemark.sources.schema import Invariants

    checks = Invariants().empty("none", spark.range(0)).empty("two", spark.range(2)).at_least("some", spark.range(1)).at_least("many", spark.range(3), 4).at_most("few", [spark.range(2), spark.range(3)], 5).at_most("fewer", [spark.range(2), spark.range(3)], 4)
    assert {r.name: r.violations for r in checks.run(spark).collect()} == {"none": 0, "two": 2, "some": 0, "many": 1, "few": 0, "fewer": 1}
    with pytest.raises(AssertionError, match=r"two \(2\), many \(1\), fewer \(1\)"):
        checks.demand(spark)


def test_states_and_batch_losses_equal_loops(spark):
    from tidemark.operators import neural
    from tidemark.operators.splits import md5_order

    rng = np.random.default_rng(6)
    d, long = 6, 4
    w = lambda *shape: 0.4 * rng.normal(size=shape)
    near = lambda: (1 + w(d), w(d))
    layer = neural.Layer(w(3 * d, d), w(3 * d), w(d, d), w(d), w(9, d), w(9), w(d, 9), w(d), near(), near())
    model = neural.Encoder(w(long, d), near(), (layer,), 2)
    weight, bias, raw = w(d, 5), w(d), {i: rng.normal(size=5).tolist() for i in range(20)}
    items = neural.content_vectors(spark.createDataFrame(list(raw.items()), "dense_id long, vec array<double>").repartition(3), weight, bias)
    vec = {r.dense_id: np.array(r.vec) for r in items.collect()}
    for i, v in raw.items():
        x = weight @ np.array(v) + bias
        assert np.allclose(vec[i], x / np.linalg.norm(x))
    seqs = {u: rng.integers(0, 20, n).tolist() for u, n in enumerate([0, 1, 2, 4, 7, 3, 5])}
    df = spark.createDataFrame(list(seqs.items()), "uid long, items array<long>")
    got = {(r.uid, r.pos): (r.dense_id, r.vec) for r in neural.position_states(df, items, model).collect()}
    last = {r.uid: r.vec for r in neural.user_vectors(df, items, model).collect()}
    for u, s in seqs.items():
        s = s[-long:]
        assert sum(v == u for v, _ in got) == len(s)
        if s:
            states = neural.hidden_states(model, np.array([[vec[i] for i in s]]), np.array([len(s)]))[0]
            for p, i in enumerate(s):
                assert got[u, p][0] == i and np.allclose(got[u, p][1], states[p])
            assert np.allclose(last[u], states[-1])
        else:
            assert last[u] == [0.0] * d
    at = [(u, p, v, (i + 1) % 20) for (u, p), (i, v) in got.items()]
    positions = spark.createDataFrame(at, "uid long, pos long, vec array<double>, positive long").repartition(4)
    log_q = {i: float(np.log((i + 1) / 210)) for i in range(20)}
    out = {r.batch: (r.n, r.loss) for r in neural.batch_losses(positions, items, spark.createDataFrame(list(log_q.items()), "dense_id long, log_q double"), 20, 8, 5, 3, -1.0).collect()}
    batches = -(-len(at) // 8)
    keyed = positions.withColumn("h", md5_order(3, "uid", "pos")).collect()
    members = defaultdict(list)
    for r in sorted(keyed, key=lambda r: (r.uid, r.pos)):
        members[int(int(r.h[:12], 16) / (1 << 48) * batches)].append(r)
    assert out.keys() == members.keys()
    for b, rows in members.items():
        draws = [int(int(hashlib.md5(f"3:n:{b}:{k}".encode()).hexdigest()[:12], 16) / (1 << 48) * 20) for k in range(5)]
        slow = neural.sampled_softmax(np.array([r.vec for r in rows]), np.array([r.uid for r in rows]), np.array([r.positive for r in rows]), np.array([vec[i] for i in range(20)]), np.array([log_q[i] for i in range(20)]), np.array(draws), -1.0)
        assert out[b] == (len(rows), pytest.approx(slow))
    missing = neural.batch_losses(positions, items.filter("dense_id > 0"), spark.createDataFrame(list(log_q.items()), "dense_id long, log_q double"), 20, 8, 0, 3, 0.0)
    if any(r.positive == 0 for r in keyed):
        with pytest.raises(Exception, match="no vector or log q"):
            missing.collect()
