"""Registered queries of what goes beyond the reference's own operators: codes, neighbours, time, factors, streams.

Each has the SQL that checks it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DAY, FIXTURE, WEEK
from ..operators import codes, factors, metrics, moments, neighbours, neural, profile, ranking, sequences, splits, vectors
from ..operators.codes import GRID
from ..sources import tables
from ..sources.work import materialise, shared_dir
from ..streaming import weekly
from .prepare import prepare
from .queries import _SEQ, by_position, r6, register

LEVELS, SIZE, ROUNDS, SEED = 3, 16, 3, FIXTURE.seed

# ---- residual codes


def _codes_sql(source: str, key: str) -> str:
    """CTEs: b1 to b{LEVELS} are codebooks, coded has (key, level, code, residual) of all of ``source`` (key, v on the grid)."""
    away = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    out = f"r0 AS MATERIALIZED (SELECT {key} AS key, v FROM {source})"
    near = lambda rows, book: f"(SELECT x.key, x.v, c.c, c.v AS cv, {away} AS d FROM {rows} x, {book} c) QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, c) = 1"
    for n in range(1, LEVELS + 1):
        out += f", k{n}_0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('{SEED}:{n - 1}:' || key), key) - 1 AS c, v FROM r{n - 1} QUALIFY row_number() OVER (ORDER BY md5('{SEED}:{n - 1}:' || key), key) <= {SIZE})"
        for i in range(1, ROUNDS + 1):
            out += f""", a{n}_{i} AS MATERIALIZED (SELECT key, v, c FROM {near(f"r{n - 1}", f"k{n}_{i - 1}")})
, m{n}_{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n}_{i}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c)
, k{n}_{i} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM k{n}_{i - 1} o LEFT JOIN m{n}_{i} m ON m.c = o.c)"""
        out += f", e{n} AS MATERIALIZED (SELECT key, c, d, list_transform(list_zip(v, cv), lambda p: p[1] - p[2]) AS v FROM {near(f'r{n - 1}', f'k{n}_{ROUNDS}')}), r{n} AS (SELECT key, v FROM e{n})"
    return out + ", coded AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT key, {n}::INT AS level, c::INT AS code, d AS residual FROM e{n}" for n in range(1, LEVELS + 1)) + ")"


_ON_GRID = f"list_transform(embedding, lambda x: floor(x::DOUBLE * {GRID} + 0.5::DOUBLE)::BIGINT)"
_ITEM_CODES = f"ig AS MATERIALIZED (SELECT vec_id AS item_id, {_ON_GRID} AS v FROM embeddings), {_codes_sql('ig', 'item_id')}"
_POOLED = f"""ig AS MATERIALIZED (SELECT vec_id AS item_id, {_ON_GRID} AS v FROM embeddings)
, ug AS MATERIALIZED (SELECT uid, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT uid, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM train JOIN ig USING (item_id), range(1, 65) t(i) GROUP BY uid, i) GROUP BY uid)"""
_USER_CODES = f"{_POOLED}, {_codes_sql('ug', 'uid')}, whole AS MATERIALIZED (SELECT key AS uid, list(code ORDER BY level) AS codes FROM coded GROUP BY key)"


def _item_codes(spark, d) -> DataFrame:
    items = tables.vectors(spark, d).select("item_id", codes.on_grid(F.col("vec")).alias("v"))
    return codes.encode(items, codes.learn(items, LEVELS, SIZE, ROUNDS, SEED))


def _user_codes(spark, d):
    users = codes.pooled(prepare(spark, d).train, tables.vectors(spark, d))
    books = codes.learn(users, LEVELS, SIZE, ROUNDS, SEED, "uid")
    return codes.encode(users, books), books


@register("X4_residual_codes", f"WITH {_ITEM_CODES} SELECT key AS item_id, level, code, residual FROM coded", prep=False)
def _(spark, d):
    return codes.by_level(_item_codes(spark, d))


@register("X7_code_use", f"WITH {_ITEM_CODES} SELECT level, count(DISTINCT code) AS used, count(DISTINCT code) / {SIZE} AS share, round(sum(residual) / count(*) / {float(GRID * GRID)}::DOUBLE, 6) AS error FROM coded GROUP BY level", prep=False)
def _(spark, d):
    return r6(codes.level_report(_item_codes(spark, d), SIZE), "error")


@register("X4_user_codes", f", {_USER_CODES} SELECT key AS uid, level, code, residual FROM coded")
def _(spark, d):
    return codes.by_level(_user_codes(spark, d)[0])


_prefix = "array_to_string(codes[1:{n}], '.')"
_LISTS = f"""{_USER_CODES}, lv AS (SELECT unnest(range(0, {LEVELS + 1}))::INT AS n), gr AS MATERIALIZED (SELECT uid, n, CASE WHEN n = 0 THEN '' ELSE {_prefix.format(n='n')} END AS prefix FROM whole, lv)
, sz AS MATERIALIZED (SELECT n, prefix, count(*) AS users FROM gr GROUP BY ALL)
, q AS MATERIALIZED (SELECT gr.uid, w.n AS level, max(gr.n) AS used_level FROM gr JOIN sz USING (n, prefix) JOIN lv w ON w.n >= 1 AND gr.n <= w.n WHERE gr.uid IN (SELECT uid FROM test) AND (users >= {codes.LEAST_USERS} OR gr.n = 0) GROUP BY ALL)
, ls AS MATERIALIZED (SELECT n, prefix, item_id, count(*) AS score, row_number() OVER (PARTITION BY n, prefix ORDER BY count(*) DESC, item_id)::INT AS rank FROM train JOIN gr USING (uid) GROUP BY n, prefix, item_id QUALIFY rank <= 10)
, lists AS MATERIALIZED (SELECT q.uid, q.level, q.used_level, rank, item_id, score FROM q JOIN gr ON gr.uid = q.uid AND gr.n = q.used_level JOIN ls ON ls.n = gr.n AND ls.prefix = gr.prefix)"""


def _code_lists(spark, d) -> DataFrame:
    p = prepare(spark, d)
    coded = _user_codes(spark, d)[0].select("uid", "codes")
    return codes.code_lists(p.train, coded, coded.join(p.test.select("uid").distinct(), "uid", "left_semi"), LEVELS, 10)


@register("X1_X8_prefix_lists", f", {_LISTS} SELECT * FROM lists")
def _(spark, d):
    return _code_lists(spark, d)


@register("X8_back_offs", f", {_LISTS} SELECT level, count(*) AS users, sum((used_level < level)::INT)::BIGINT AS backed_off, sum((used_level < level)::INT) / count(*) AS share FROM lists WHERE rank = 1 GROUP BY level")
def _(spark, d):
    return codes.back_offs(_code_lists(spark, d))


@register("X2_permuted_codes", f", {_USER_CODES}, a AS (SELECT uid, row_number() OVER (ORDER BY uid) AS i FROM whole), b AS (SELECT codes, row_number() OVER (ORDER BY md5('{SEED}:' || uid), uid) AS i FROM whole) SELECT uid, array_to_string(codes, '.') AS codes FROM a JOIN b USING (i)")
def _(spark, d):
    coded = _user_codes(spark, d)[0].select("uid", "codes")
    return codes.permuted(coded, SEED).withColumn("codes", F.array_join(F.col("codes").cast("array<string>"), "."))


def _nearest_sql(rows: str, level: int) -> str:
    away = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"SELECT uid, cut, c AS code, list_transform(list_zip(v, cv), lambda p: p[1] - p[2]) AS v FROM (SELECT x.uid, x.cut, x.v, c.c, c.v AS cv, {away} AS d FROM {rows} x, k{level}_{ROUNDS} c) QUALIFY row_number() OVER (PARTITION BY uid, cut ORDER BY d, c) = 1"


_STABLE = f"""{_USER_CODES}, hist AS MATERIALIZED (SELECT uid, v, row_number() OVER (PARTITION BY uid ORDER BY timestamp, item_id) AS pos, count(*) OVER (PARTITION BY uid) AS n FROM train JOIN ig USING (item_id))
, h0 AS MATERIALIZED (SELECT uid, cut, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT uid, cut, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM hist, (VALUES {", ".join(f"({c})" for c in codes.CUTS)}) cs(cut), range(1, 65) t(i) WHERE pos <= (cut * n + 99) // 100 GROUP BY uid, cut, i) GROUP BY uid, cut)
""" + "".join(f", h{n} AS MATERIALIZED ({_nearest_sql(f'h{n - 1}', n)})" for n in range(1, LEVELS + 1)) + ", hc AS (" + " UNION ALL ".join(f"SELECT uid, cut, {n}::INT AS level, code FROM h{n}" for n in range(1, LEVELS + 1)) + ")"


@register("X10_code_stability", f", {_STABLE} SELECT a.cut::INT AS cut, a.level, count(*) AS users, sum((a.code = b.code)::INT)::BIGINT AS equal, sum((a.code = b.code)::INT) / count(*) AS share FROM hc a JOIN hc b ON a.uid = b.uid AND a.level = b.level AND b.cut = 100 GROUP BY ALL")
def _(spark, d):
    items = tables.vectors(spark, d)
    books = _user_codes(spark, d)[1]
    return codes.stability(codes.encode(codes.history_cuts(prepare(spark, d).train, items), books))


# ---- neighbours

_SEEN = "seen AS MATERIALIZED (SELECT DISTINCT uid, item_id FROM train), ni AS MATERIALIZED (SELECT item_id, count(*) AS n FROM seen GROUP BY item_id)"
_ITEM_KNN = f"""{_SEEN}, co AS MATERIALIZED (SELECT a.item_id, b.item_id AS neighbour, count(*) AS m FROM seen a JOIN seen b ON a.uid = b.uid AND a.item_id <> b.item_id GROUP BY ALL)
, sim AS (SELECT co.item_id, neighbour, round(m / sqrt(x.n::DOUBLE * y.n), 10) AS score FROM co JOIN ni x ON x.item_id = co.item_id JOIN ni y ON y.item_id = neighbour)
, knn AS MATERIALIZED (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neighbour)::INT AS rank, neighbour, score FROM sim QUALIFY rank <= 10)"""


@register("item_knn", f", {_ITEM_KNN} SELECT item_id, rank, neighbour, round(score, 6) AS score FROM knn")
def _(spark, d):
    return r6(neighbours.item_neighbours(prepare(spark, d).train, 10), "score")


@register("item_knn_lists", f""", {_ITEM_KNN}, mine AS (SELECT seen.* FROM seen SEMI JOIN test USING (uid)), w AS (SELECT uid, neighbour AS item_id, sum(round(score * {neighbours.STEPS})::BIGINT)::BIGINT AS score FROM mine JOIN knn USING (item_id) GROUP BY uid, neighbour)
SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY score DESC, item_id)::INT AS rank, item_id, score FROM w ANTI JOIN seen USING (uid, item_id) QUALIFY rank <= 10""")
def _(spark, d):
    p = prepare(spark, d)
    return neighbours.item_lists(p.train, p.test, neighbours.item_neighbours(p.train, 10), 10)


_UNIT_USERS = "uu AS MATERIALIZED (SELECT uid, list_transform(v, lambda x: x / CASE WHEN n > 0 THEN n ELSE 1 END) AS v FROM (SELECT uid, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM ug))"
_USER_KNN = f"""{_POOLED}, {_UNIT_USERS}, us AS (SELECT a.uid, b.uid AS neighbour, round(list_dot_product(a.v, b.v), 10) AS score FROM uu a, uu b WHERE a.uid <> b.uid AND a.uid IN (SELECT uid FROM test))
, un AS MATERIALIZED (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY score DESC, neighbour)::INT AS rank, neighbour, score FROM us QUALIFY rank <= 10)"""


def _user_neighbours(spark, d) -> DataFrame:
    p = prepare(spark, d)
    users = materialise(codes.pooled(p.train, tables.vectors(spark, d)).withColumnRenamed("v", "vec"))
    return neighbours.user_neighbours(users.join(p.test.select("uid").distinct(), "uid", "left_semi"), users, 10)


@register("X3_user_knn", f", {_USER_KNN} SELECT uid, rank, neighbour, round(score, 6) AS score FROM un")
def _(spark, d):
    return r6(_user_neighbours(spark, d), "score")


_NEIGHBOUR_LISTS = f"""{_USER_KNN}, nl AS MATERIALIZED (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY score DESC, item_id)::INT AS rank, item_id, score FROM
(SELECT un.uid, t.item_id, sum(round(score * {neighbours.STEPS})::BIGINT)::BIGINT AS score FROM un JOIN (SELECT DISTINCT uid, item_id FROM train) t ON t.uid = neighbour GROUP BY ALL) QUALIFY rank <= 10)"""


@register("X3_user_knn_lists", f", {_NEIGHBOUR_LISTS} SELECT * FROM nl")
def _(spark, d):
    return neighbours.neighbour_lists(prepare(spark, d).train, _user_neighbours(spark, d), 10)


def _list_metrics_sql(lists: str) -> str:
    """recall, hitrate and coverage at 10 of ranked lists (uid, rank, item_id), over test users who have one."""
    return f"""tt AS MATERIALIZED (SELECT DISTINCT uid, item_id FROM test SEMI JOIN {lists} USING (uid)), hh AS (SELECT uid, count(tt.uid) AS hits FROM {lists} LEFT JOIN tt USING (uid, item_id) GROUP BY uid), tn AS (SELECT uid, count(*) AS n FROM tt GROUP BY uid)
SELECT 'recall' AS metric, 10 AS k, round(avg(hits / least(n, 10)), 6) AS value FROM hh JOIN tn USING (uid) UNION ALL SELECT 'hitrate', 10, round(avg((hits > 0)::INT), 6) FROM hh UNION ALL SELECT 'coverage', 10, round((SELECT count(DISTINCT item_id) FROM {lists}) / (SELECT count(*) FROM id_map), 6)"""


def _list_metrics(spark, d, lists: DataFrame) -> DataFrame:
    p = prepare(spark, d)
    lists = materialise(lists)
    goal = p.test.join(lists.select("uid").distinct(), "uid", "left_semi")
    return r6(metrics.evaluate(lists, goal, p.id_map.count(), ["recall@10", "hitrate@10", "coverage@10"]), "value")


@register("X3_user_knn_metrics", f", {_NEIGHBOUR_LISTS}, {_list_metrics_sql('nl')}")
def _(spark, d):
    return _list_metrics(spark, d, neighbours.neighbour_lists(prepare(spark, d).train, _user_neighbours(spark, d), 10).withColumn("score", F.col("score").cast("double")))


# ---- moments

_HALF = 30 * DAY


@register("decayed_popularity", f", m AS (SELECT DISTINCT item_id, timestamp FROM test) SELECT m.item_id, m.timestamp, round(coalesce(sum(pow(2::DOUBLE, -(m.timestamp - f.timestamp)::DOUBLE / {_HALF})), 0), 6) AS decayed FROM m LEFT JOIN fixed f ON f.item_id = m.item_id AND f.timestamp < m.timestamp GROUP BY ALL")
def _(spark, d):
    """Each test item's popularity just before each of its events, from the whole log up to then."""
    p = prepare(spark, d)
    return r6(moments.decayed_before(p.log, p.test.select("item_id", "timestamp").distinct(), "item_id", _HALF), "decayed")


_ASOF = """, um AS MATERIALIZED (SELECT uid, timestamp, max(item_id) AS last_item FROM fixed GROUP BY ALL), im AS MATERIALIZED (SELECT item_id, timestamp, max(uid) AS last_uid FROM fixed GROUP BY ALL)
, a AS (SELECT t.uid, t.item_id, t.timestamp, u.last_item AS user_item_id, u.timestamp AS user_timestamp FROM test t ASOF LEFT JOIN um u ON t.uid = u.uid AND t.timestamp > u.timestamp)
SELECT a.*, i.last_uid AS item_uid, i.timestamp AS item_timestamp FROM a ASOF LEFT JOIN im i ON a.item_id = i.item_id AND a.timestamp > i.timestamp"""


@register("as_of_last_events", _ASOF)
def _(spark, d):
    """Each test event with the last earlier event of its user and of its item."""
    p = prepare(spark, d)
    rows = p.test.select("uid", "item_id", "timestamp")
    rows = moments.last_before(p.log, rows, "uid", ["item_id", "timestamp"], "user_")
    return moments.last_before(p.log, rows, "item_id", ["uid", "timestamp"], "item_")


# ---- factors

_ALPHA, _PENALTY, _TURNS = factors.ALPHA, factors.PENALTY, 3


def _als_sql() -> str:
    """f{t}u and f{t}i: vectors of two components after round t, by Cramer's rule; cost{t} is the objective."""
    unit = lambda j: f"('0x' || substr(md5('{SEED}:{j}:' || item_id), 1, 12))::BIGINT::DOUBLE / 281474976710656 / 2"
    out = f"pr AS MATERIALIZED (SELECT uid, item_id, count(*) AS n FROM train GROUP BY ALL), f0i AS MATERIALIZED (SELECT item_id AS id, {unit(0)} AS x, {unit(1)} AS y FROM (SELECT DISTINCT item_id FROM train))"

    def half(name: str, mine: str, other: str, given: str) -> str:
        return f""", g{name} AS MATERIALIZED (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM {given})
, {name} AS MATERIALIZED (SELECT id, (p * d - q * b) / (a * d - b * b) AS x, (a * q - b * p) / (a * d - b * b) AS y FROM (
SELECT {mine} AS id, {_PENALTY}::DOUBLE + any_value(xx) + sum(n * {_ALPHA}::DOUBLE * x * x) AS a, any_value(xy) + sum(n * {_ALPHA}::DOUBLE * x * y) AS b, {_PENALTY}::DOUBLE + any_value(yy) + sum(n * {_ALPHA}::DOUBLE * y * y) AS d,
sum((1 + n * {_ALPHA}::DOUBLE) * x) AS p, sum((1 + n * {_ALPHA}::DOUBLE) * y) AS q FROM pr JOIN {given} v ON v.id = {other}, g{name} GROUP BY {mine}))"""

    for t in range(1, _TURNS + 1):
        out += half(f"f{t}u", "uid", "item_id", f"f{t - 1}i") + half(f"f{t}i", "item_id", "uid", f"f{t}u")
        out += f""", cost{t} AS (SELECT {t} AS round, (SELECT sum(c * (1 - s) * (1 - s) - s * s) FROM (SELECT 1 + n * {_ALPHA}::DOUBLE AS c, u.x * i.x + u.y * i.y AS s FROM pr JOIN f{t}u u ON u.id = uid JOIN f{t}i i ON i.id = item_id))
 + (SELECT a.xx * b.xx + 2 * a.xy * b.xy + a.yy * b.yy + {_PENALTY}::DOUBLE * (a.xx + a.yy + b.xx + b.yy) FROM (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM f{t}u) a, (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM f{t}i) b) AS cost)"""
    return out


_ALS = _als_sql()


def _als(spark, d):
    return factors.factorise(prepare(spark, d).train, 2, _TURNS)


@register("ials_factors", f", {_ALS} SELECT 'user' AS side, id, round(x, 6) AS x, round(y, 6) AS y FROM f{_TURNS}u UNION ALL SELECT 'item', id, round(x, 6), round(y, 6) FROM f{_TURNS}i")
def _(spark, d):
    users, items, _ = _als(spark, d)
    rows = users.withColumn("side", F.lit("user")).unionByName(items.withColumn("side", F.lit("item")))
    return r6(rows.select("side", "id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), "x", "y")


@register("ials_objective", f", {_ALS} " + " UNION ALL ".join(f"SELECT round::INT AS round, round(cost, 3) AS cost FROM cost{t}" for t in range(1, _TURNS + 1)))
def _(spark, d):
    costs = _als(spark, d)[2]
    return spark.createDataFrame(list(enumerate(costs, 1)), "round int, cost double").withColumn("cost", F.round("cost", 3))


_ALS_LISTS = f"{_ALS}, sc AS (SELECT u.id AS uid, i.id AS item_id, round(u.x * i.x + u.y * i.y, 10) AS score FROM f{_TURNS}u u, f{_TURNS}i i WHERE u.id IN (SELECT uid FROM test)), al AS MATERIALIZED (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY score DESC, item_id)::INT AS rank, item_id FROM sc QUALIFY rank <= 10)"


@register("ials_metrics", f", {_ALS_LISTS}, {_list_metrics_sql('al')}")
def _(spark, d):
    """The factors' own ranking of all items (R1), scored (M1 to M8)."""
    p = prepare(spark, d)
    users, items, _ = _als(spark, d)
    asked = users.withColumnRenamed("id", "uid").join(p.test.select("uid").distinct(), "uid", "left_semi")
    return _list_metrics(spark, d, ranking.rank_blocks(asked, items.withColumnRenamed("id", "item_id"), 10))


# ---- streams

_DELAY = 3 * DAY


@register("A12_streaming", f""", ends AS (SELECT min(timestamp) AS low, max(timestamp) AS high FROM fixed), again AS (SELECT (timestamp - low) // {WEEK} AS week, count(*) AS late FROM fixed, ends WHERE timestamp < low + (high - low) // 3 AND uid % 10 = 0 GROUP BY 1)
SELECT weeks.week, interactions, active_users, coalesce(late, 0)::BIGINT AS late FROM weeks LEFT JOIN again USING (week)""")
def _(spark, d):
    """The log as three files by time, each with a run of its own that goes on from the last; with the third, some rows of the first come again and are late."""
    log = prepare(spark, d).log
    low, high = log.agg(F.min("timestamp"), F.max("timestamp")).first()
    base = shared_dir(spark)
    source, sink, checkpoint = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    third = (high - low) // 3
    t = F.col("timestamp")
    first = t < low + third
    for part in (first, (t >= low + third) & (t < low + 2 * third), (t >= low + 2 * third) | (first & (F.col("uid") % 10 == 0))):
        log.filter(part).select(*tables.INTERACTIONS.fieldNames()).write.mode("append").parquet(source)
        weekly.run(spark, source, sink, checkpoint, low, _DELAY)
    weekly.close(spark, source, high, _DELAY)
    weekly.run(spark, source, sink, checkpoint, low, _DELAY)
    weeks = spark.read.schema("week long, interactions long, active_users long").parquet(sink)
    return weeks.join(weekly.late_rows(spark, source, sink, low), "week")


# ---- the encoder with layers, over content vectors

_DIM, _HEADS, _FF, _LONG, _TAU = 8, 2, 16, 10, -1.0
_BATCH, _DRAWS, _MOST = 64, 32, 5_000


def _seeded_model() -> tuple[neural.Encoder, np.ndarray, np.ndarray]:
    """Two layers of two heads, and the map from embeddings to their space, all from one seed."""
    rng = np.random.default_rng(SEED)
    some = lambda *shape: np.round(0.5 * rng.normal(size=shape), 4)
    near_one = lambda: (1 + 0.2 * some(_DIM), 0.2 * some(_DIM))
    layers = tuple(neural.Layer(some(3 * _DIM, _DIM), some(3 * _DIM), some(_DIM, _DIM), some(_DIM), some(_FF, _DIM), some(_FF), some(_DIM, _FF), some(_DIM), near_one(), near_one()) for _ in range(2))
    return neural.Encoder(some(_LONG, _DIM), near_one(), layers, _HEADS), some(_DIM, 64), some(_DIM)


def _content_items(spark, d) -> DataFrame:
    _, weight, bias = _seeded_model()
    return neural.content_vectors(vectors.aligned(tables.vectors(spark, d), prepare(spark, d).id_map, 64), weight, bias)


def _number(a) -> str:
    """An array as a literal list of doubles."""
    a = np.asarray(a)
    text = str(a.tolist()) if a.ndim else repr(float(a))
    return f"{text}::DOUBLE" + "[]" * a.ndim


def _linear(x: str, weight: np.ndarray, bias: np.ndarray) -> str:
    return f"list_transform(list_zip({_number(weight)}, {_number(bias)}), lambda w: list_dot_product(w[1], {x}) + w[2])"


def _plus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] + p[2])"


def _layer_norm(x: str, p: tuple[np.ndarray, np.ndarray]) -> str:
    return f"list_transform(list_zip({x}, {_number(p[0])}, {_number(p[1])}), lambda p: (p[1] - list_avg({x})) / sqrt(list_avg(list_transform({x}, lambda y: (y - list_avg({x})) * (y - list_avg({x})))) + 1e-9::DOUBLE) * p[2] + p[3])"


def _erf(x: str) -> str:
    """The polynomial of neural.erf()."""
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x})))"
    poly = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))"
    return f"(sign({x}) * (1 - {poly} * exp(-{x} * {x})))"


def _states_sql(positions: str) -> str:
    """CTEs up to st (uid, pos, n, x): states of ``positions`` (uid, pos, n, dense_id), over item vectors cv (dense_id, v)."""
    model, _, _ = _seeded_model()
    size = _DIM // _HEADS
    out = f"l0a AS MATERIALIZED (SELECT uid, pos, n, {_plus('v', f'({_number(model.positions)})[n - pos]')} AS x FROM {positions} JOIN cv USING (dense_id)), l0 AS MATERIALIZED (SELECT uid, pos, n, {_layer_norm('x', model.norm)} AS x FROM l0a)"
    for t, layer in enumerate(model.layers, 1):
        part = lambda side, k, h: f"{side}.h[{k * _DIM + h * size + 1}:{k * _DIM + (h + 1) * size}]"
        weights = ", ".join(f"exp(list_dot_product({part('a', 0, h)}, {part('b', 1, h)}) / sqrt({size}::DOUBLE)) AS e{h}" for h in range(_HEADS))
        mixed = ", ".join(f"sum(e{c // size} * v[{c + 1}]) / sum(e{c // size})" for c in range(_DIM))
        out += f""", q{t} AS MATERIALIZED (SELECT uid, pos, n, x, {_linear('x', layer.in_weight, layer.in_bias)} AS h FROM l{t - 1})
, p{t} AS (SELECT a.uid, a.pos, b.h[{2 * _DIM + 1}:{3 * _DIM}] AS v, {weights} FROM q{t} a JOIN q{t} b ON a.uid = b.uid AND b.pos <= a.pos), o{t} AS MATERIALIZED (SELECT uid, pos, [{mixed}] AS o FROM p{t} GROUP BY uid, pos)
, s{t} AS MATERIALIZED (SELECT uid, pos, n, {_plus('x', _linear('o', layer.out_weight, layer.out_bias))} AS x FROM q{t} JOIN o{t} USING (uid, pos)), y{t} AS MATERIALIZED (SELECT uid, pos, n, {_layer_norm('x', layer.norm1)} AS x FROM s{t})
, u{t} AS MATERIALIZED (SELECT uid, pos, n, x, {_linear('x', layer.up_weight, layer.up_bias)} AS u FROM y{t}), g{t} AS MATERIALIZED (SELECT uid, pos, n, x, list_transform(u, lambda w: w * 0.5::DOUBLE * (1 + {_erf('(w / sqrt(2::DOUBLE))')})) AS g FROM u{t})
, z{t} AS MATERIALIZED (SELECT uid, pos, n, {_plus('x', _linear('g', layer.down_weight, layer.down_bias))} AS x FROM g{t}), l{t} AS MATERIALIZED (SELECT uid, pos, n, {_layer_norm('x', layer.norm2)} AS x FROM z{t})"""
    return out + f", st AS (SELECT * FROM l{len(model.layers)})"


_CONTENT = f"""cw AS MATERIALIZED (SELECT dense_id, {_linear('e', *_seeded_model()[1:])} AS w FROM (SELECT dense_id, coalesce(embedding, list_transform(range(64), lambda x: 0::FLOAT))::DOUBLE[] AS e FROM id_map LEFT JOIN embeddings ON vec_id = raw_id))
, cv AS MATERIALIZED (SELECT dense_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM cw)"""
_LAST = f"{_SEQ.format(log='train')}, tl AS (SELECT uid, items[-{_LONG}:] AS s FROM seq WHERE uid IN (SELECT uid FROM test)), ps AS MATERIALIZED (SELECT uid, (generate_subscripts(s, 1) - 1)::BIGINT AS pos, len(s) AS n, unnest(s) AS dense_id FROM tl)"
_ENCODER = f"{_CONTENT}, {_LAST}, {_states_sql('ps')}, lastst AS MATERIALIZED (SELECT uid, x FROM st WHERE pos = n - 1)"


@register("N1_N2_content_vectors", f", {_CONTENT} SELECT dense_id, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v), 6) AS value FROM cv")
def _(spark, d):
    return by_position(_content_items(spark, d), "dense_id")


@register("N3_N4_layered_user_vectors", f", {_ENCODER} SELECT uid, (generate_subscripts(x, 1) - 1)::INT AS pos, round(unnest(x), 6) AS value FROM lastst")
def _(spark, d):
    """Test users' last states through two layers of two heads."""
    p = prepare(spark, d)
    seqs = sequences.sequences(p.train, p.id_map).join(p.test.select("uid").distinct(), "uid", "left_semi")
    return by_position(neural.user_vectors(seqs, _content_items(spark, d), _seeded_model()[0]), "uid")


@register("N9_layered_metrics", f""", {_ENCODER}, es AS (SELECT uid, dense_id AS item_id, round(list_dot_product(x, v), 10) AS score FROM lastst, cv), el AS MATERIALIZED (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY score DESC, item_id)::INT AS rank, item_id FROM es QUALIFY rank <= 10)
, {_list_metrics_sql('el').replace('FROM test SEMI', 'FROM (SELECT uid, dense_id AS item_id FROM test JOIN id_map ON raw_id = item_id) SEMI')}""")
def _(spark, d):
    p = prepare(spark, d)
    goal = splits.to_dense(p.test, p.id_map).select("uid", F.col("dense_id").alias("item_id"))
    return r6(neural.evaluate(sequences.sequences(p.train, p.id_map), materialise(_content_items(spark, d)), _seeded_model()[0], goal, ["recall@10", "hitrate@10", "coverage@10"])[0], "value")


_UNIT_MD5 = "('0x' || substr(md5({x}), 1, 12))::BIGINT::DOUBLE / 281474976710656"
_TRAINING = f"""{_SEQ.format(log='train')}, nx AS (SELECT uid, items[1:-2][-{_LONG}:] AS s, items[2:][-{_LONG}:] AS t FROM seq WHERE len(items) >= 2)
, ps AS MATERIALIZED (SELECT uid, (generate_subscripts(s, 1) - 1)::BIGINT AS pos, len(s) AS n, unnest(s) AS dense_id, unnest(t) AS positive FROM nx)"""


@register("N5_N7_batch_losses", f""", {_CONTENT}, {_TRAINING}, {_states_sql('ps')}, cp AS MATERIALIZED (SELECT st.uid, st.pos, st.x, ps.positive FROM st JOIN ps USING (uid, pos) ORDER BY md5('{SEED}:' || uid || ':' || pos), uid, pos LIMIT {_MOST})
, lq AS (SELECT dense_id, ln(greatest(popularity / (SELECT count(*) FROM train), 1e-9)) AS lq FROM id_map JOIN pop ON item_id = raw_id)
, ba AS MATERIALIZED (SELECT floor({_UNIT_MD5.format(x=f"'{SEED + 1}:' || uid || ':' || pos")} * (((SELECT count(*) FROM cp) + {_BATCH - 1}) // {_BATCH}))::BIGINT AS batch, uid, pos, x, v, lq FROM cp JOIN cv ON cv.dense_id = positive JOIN lq ON lq.dense_id = positive)
, ng AS MATERIALIZED (SELECT batch, v FROM (SELECT batch, floor({_UNIT_MD5.format(x=f"'{SEED + 1}:n:' || batch || ':' || draw")} * (SELECT count(*) FROM id_map))::BIGINT AS dense_id FROM (SELECT DISTINCT batch FROM ba), range({_DRAWS}) r(draw)) JOIN cv USING (dense_id))
, own AS (SELECT batch, uid, pos, list_dot_product(x, v) / exp({_TAU}::DOUBLE) AS own FROM ba)
, inb AS (SELECT a.batch, a.uid, a.pos, sum(exp(list_dot_product(a.x, b.v) / exp({_TAU}::DOUBLE) - b.lq)) FILTER (a.uid <> b.uid) AS z FROM ba a JOIN ba b USING (batch) GROUP BY ALL)
, dr AS (SELECT a.batch, a.uid, a.pos, sum(exp(list_dot_product(a.x, ng.v) / exp({_TAU}::DOUBLE) + ln((SELECT count(*) FROM id_map)))) AS z FROM ba a JOIN ng USING (batch) GROUP BY ALL)
SELECT batch, count(*) AS n, round(avg(ln(exp(own) + coalesce(inb.z, 0) + dr.z) - own), 6) AS loss FROM own JOIN inb USING (batch, uid, pos) JOIN dr USING (batch, uid, pos) GROUP BY batch""")
def _(spark, d):
    """The loss at positions of the training sequences: states of the layered encoder, capped, against batch and drawn negatives."""
    p = prepare(spark, d)
    items = materialise(_content_items(spark, d))
    seqs = sequences.next_items(sequences.sequences(p.train, p.id_map), _LONG)
    states = neural.position_states(seqs, items, _seeded_model()[0])
    goal = seqs.select("uid", F.posexplode("positives").alias("pos", "positive"))
    at = states.join(goal.withColumn("pos", F.col("pos").cast("long")), ["uid", "pos"]).select("uid", "pos", "vec", "positive")
    at = materialise(neural.capped_positions(at, _MOST, SEED))
    log_q = neural.log_q(profile.popularity(p.train, p.id_map))
    return r6(neural.batch_losses(at, items, log_q, p.id_map.count(), _BATCH, _DRAWS, SEED + 1, _TAU), "loss")
