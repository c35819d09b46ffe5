"""Registered queries of the interaction-log operators, each with the SQL that checks it.

Numbers that are not exact are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIXTURE, WEEK
from ..operators import cleaning, metrics, neural, profile, ranking, sequences, significance, splits, vectors
from ..sources import schema, sinks, tables
from ..sources.work import materialise, shared_dir
from .prepare import prepare, report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WINDOW = FIXTURE.test_seconds
_LOG = "uid, item_id, timestamp, is_organic, played_ratio_pct, track_length_seconds"
_rounds = "".join(
    f", f{i} AS MATERIALIZED (SELECT * FROM f{i - 1} WHERE uid IN (SELECT uid FROM f{i - 1} GROUP BY uid HAVING count(*) >= {FIXTURE.min_user})"
    f" AND item_id IN (SELECT item_id FROM f{i - 1} GROUP BY item_id HAVING count(*) >= {FIXTURE.min_item}))"
    for i in range(1, 11)
)
PREP = f"""WITH raw AS MATERIALIZED (
  SELECT o_custkey AS uid, l_partkey AS item_id, (epoch(o_orderdate) - (SELECT min(epoch(o_orderdate)) FROM orders))::BIGINT AS timestamp,
    (CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::SMALLINT AS is_organic, (l_quantity * 2)::INT AS played_ratio_pct, (p_size * 5)::BIGINT AS track_length_seconds
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), exact AS MATERIALIZED (SELECT DISTINCT * FROM raw
), keyed AS MATERIALIZED (
  SELECT {_LOG} FROM exact QUALIFY row_number() OVER (PARTITION BY uid, timestamp, item_id ORDER BY played_ratio_pct DESC, track_length_seconds DESC, is_organic DESC) = 1
), f0 AS MATERIALIZED (SELECT * FROM keyed WHERE played_ratio_pct >= {FIXTURE.min_played}){_rounds}
, fixed AS MATERIALIZED (SELECT * FROM f10), cut AS MATERIALIZED (SELECT max(timestamp) - {WINDOW} AS t_test, max(timestamp) - {2 * WINDOW} AS t_val FROM fixed
), train AS MATERIALIZED (SELECT fixed.* FROM fixed, cut WHERE timestamp < t_val
), val_raw AS MATERIALIZED (SELECT fixed.* FROM fixed, cut WHERE timestamp >= t_val AND timestamp < t_test
), test_raw AS MATERIALIZED (SELECT fixed.* FROM fixed, cut WHERE timestamp >= t_test
), val AS MATERIALIZED (SELECT * FROM val_raw WHERE uid IN (SELECT uid FROM train) AND item_id IN (SELECT item_id FROM train)
), test AS MATERIALIZED (SELECT * FROM test_raw WHERE uid IN (SELECT uid FROM train) AND item_id IN (SELECT item_id FROM train)
), id_map AS MATERIALIZED (SELECT row_number() OVER (ORDER BY item_id) - 1 AS dense_id, item_id AS raw_id FROM (SELECT DISTINCT item_id FROM train)
), pop AS MATERIALIZED (SELECT item_id, count(*) AS popularity FROM train GROUP BY item_id
), histories AS MATERIALIZED (SELECT uid, count(*) AS length, count(DISTINCT item_id) AS unique_items FROM fixed GROUP BY uid
), weeks AS MATERIALIZED (SELECT (timestamp - (SELECT min(timestamp) FROM fixed)) // {WEEK} AS week, count(*) AS interactions, count(DISTINCT uid) AS active_users FROM fixed GROUP BY 1)
"""
DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def register(name: str, sql: str | None = None, prep: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (PREP if prep else "") + sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays of whole numbers as text, so that any engine's rows compare."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns})


def by_position(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, value): a row for each dimension of vec, rounded."""
    return df.select(*keys, F.posexplode("vec").alias("pos", "x")).select(*keys, "pos", F.round(F.col("x").cast("double"), 6).alias("value"))


def _positions(keys: str, source: str, vec: str = "embedding") -> str:
    return f"SELECT {keys}, (generate_subscripts({vec}, 1) - 1)::INT AS pos, round(unnest({vec})::DOUBLE, 6) AS value FROM {source}"


# ---- scans, projections, filters


@register("S1_scan_orders", "SELECT * FROM orders", prep=False)
def _(spark, d):
    return tables.scan(spark, d, "orders")


@register("S2_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem", prep=False)
def _(spark, d):
    return tables.scan(spark, d, "lineitem", ["l_orderkey", "l_quantity"])


@register("S3_interactions", "SELECT * FROM raw")
def _(spark, d):
    return tables.interactions(spark, d)


@register("S4_union_scan", "SELECT * FROM train UNION ALL SELECT * FROM val")
def _(spark, d):
    p = prepare(spark, d)
    return tables.scan_union([p.train, p.val])


@register("S12_plot_bins", f"SELECT least(floor(played_ratio_pct::DOUBLE / 100 * 80), 79)::INT AS bin, count(*) AS count FROM raw WHERE played_ratio_pct BETWEEN 0 AND 100 GROUP BY 1")
def _(spark, d):
    return profile.histogram(prepare(spark, d).raw, "played_ratio_pct", 0, 100, 80)


@register("P1_played", f"SELECT * FROM raw WHERE played_ratio_pct >= {FIXTURE.min_played}")
def _(spark, d):
    return cleaning.played(prepare(spark, d).raw, FIXTURE.min_played)


@register("P2_temporal_split", "SELECT fixed.*, CASE WHEN timestamp < t_val THEN 'train' WHEN timestamp < t_test THEN 'val' ELSE 'test' END AS split FROM fixed, cut")
def _(spark, d):
    p = prepare(spark, d)
    return splits.with_split(p.log, p.cut)


@register("P4_popularity_cast", "SELECT item_id, popularity FROM pop")
def _(spark, d):
    return profile.group_counts(prepare(spark, d).train, "item_id").withColumnRenamed("count", "popularity")


@register("P7_week_bucket", f"SELECT uid, item_id, timestamp, (timestamp - (SELECT min(timestamp) FROM fixed)) // {WEEK} AS week FROM fixed")
def _(spark, d):
    return profile.with_week(prepare(spark, d).log).select("uid", "item_id", "timestamp", "week")


@register("P8_organic_share", "SELECT round(avg(is_organic), 6) AS organic_share FROM raw")
def _(spark, d):
    return r6(profile.organic_share(prepare(spark, d).raw), "organic_share")


_BOUNDS = "bounds AS (SELECT round_even(quantile_cont(length, 0.25), 0) AS lo, round_even(quantile_cont(length, 0.75), 0) AS hi FROM histories)"


@register("P9_user_groups", f", {_BOUNDS} SELECT CASE WHEN length < lo THEN 'short' WHEN length < hi THEN 'medium' ELSE 'long' END AS \"group\", count(*) AS users FROM histories, bounds GROUP BY 1")
def _(spark, d):
    h = profile.histories(prepare(spark, d).log)
    low, high = profile.group_bounds(h, "length", FIXTURE.min_subgroup)
    return profile.user_groups(h, "length", low, high).groupBy("group").agg(F.count(F.lit(1)).alias("users"))


@register("P10_null_counts", "SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in _LOG.split(", ")) + " FROM raw")
def _(spark, d):
    return schema.null_counts(prepare(spark, d).raw)


@register("P10_schema_problems", "SELECT 'track_length_seconds' AS \"column\", 'missing' AS problem, '' AS found UNION ALL SELECT 'item_id', 'type', 'int' UNION ALL SELECT 'played_ratio_pct', 'nulls', count(*)::VARCHAR FROM raw WHERE played_ratio_pct < 10 UNION ALL SELECT 'uid', 'nulls', count(*)::VARCHAR FROM raw WHERE uid % 7 = 0")
def _(spark, d):
    """Of a log that lacks a column, has another of the wrong type, and nulls in two."""
    bad = prepare(spark, d).raw.drop("track_length_seconds").withColumn("item_id", F.col("item_id").cast("int"))
    bad = bad.withColumn("played_ratio_pct", F.when(F.col("played_ratio_pct") >= 10, F.col("played_ratio_pct"))).withColumn("uid", F.when(F.col("uid") % 7 != 0, F.col("uid")))
    return schema.problems(bad, tables.INTERACTIONS)


@register("P5_derived_ratio", "SELECT uid, n_after, n_before, round(1 - n_after / nullif(n_before, 0), 6) AS ratio FROM (SELECT uid, count(*) FILTER (played_ratio_pct >= 50) AS n_after, count(*) FILTER (is_organic = 1) AS n_before FROM raw GROUP BY uid)")
def _(spark, d):
    users = prepare(spark, d).raw.groupBy("uid").agg(F.count_if(F.col("played_ratio_pct") >= 50).alias("n_after"), F.count_if(F.col("is_organic") == 1).alias("n_before"))
    return users.withColumn("ratio", F.round(cleaning.derived_ratio(F.col("n_after"), F.col("n_before")), 6))


@register("P11_bad_vectors", "SELECT count(*) AS bad FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0", prep=False)
def _(spark, d):
    return vectors.bad_vectors(tables.vectors(spark, d), 64).agg(F.count(F.lit(1)).alias("bad"))


@register("P12_prefix_end", "SELECT max(timestamp) AS last, max(timestamp) < (SELECT t_val FROM cut) AS ok FROM train")
def _(spark, d):
    p = prepare(spark, d)
    return splits.leak_check(p.train, p.cut.val).agg(F.max("timestamp").alias("last")).withColumn("ok", F.col("last") < p.cut.val)


# ---- joins

_COVERED = "covered AS MATERIALIZED (SELECT * FROM raw WHERE item_id IN (SELECT vec_id FROM embeddings))"


@register("J1_covered", f", {_COVERED} SELECT * FROM covered")
def _(spark, d):
    return cleaning.covered(prepare(spark, d).raw, tables.vectors(spark, d))


@register("J2_surviving_users", f", {_COVERED} SELECT * FROM raw WHERE uid IN (SELECT uid FROM covered)")
def _(spark, d):
    raw = prepare(spark, d).raw
    return cleaning.keep_users(raw, cleaning.covered(raw, tables.vectors(spark, d)))


_LOSS = f"{_COVERED}, loss AS (SELECT uid, n_before, coalesce(n_after, 0) AS n_after, 1 - coalesce(n_after, 0) / n_before AS loss FROM (SELECT uid, count(*) AS n_before FROM raw GROUP BY uid) LEFT JOIN (SELECT uid, count(*) AS n_after FROM covered GROUP BY uid) USING (uid))"


@register("J3_loss_by_user", f", {_LOSS} SELECT uid, n_before, n_after, round(loss, 6) AS loss FROM loss")
def _(spark, d):
    raw = prepare(spark, d).raw
    return r6(cleaning.loss_by_user(raw, cleaning.covered(raw, tables.vectors(spark, d))), "loss")


@register("J4_cold_filter", "SELECT 'val' AS split, * FROM val UNION ALL SELECT 'test', * FROM test")
def _(spark, d):
    p = prepare(spark, d)
    mark = lambda x, df: df.select(F.lit(x).alias("split"), "*")
    return mark("val", splits.warm(p.val_raw, p.train)).unionByName(mark("test", splits.warm(p.test_raw, p.train)))


@register("J7_leakage", "SELECT 'train-val' AS pair, count(*) AS n FROM val SEMI JOIN train USING (uid, timestamp, item_id) UNION ALL SELECT 'train-test', count(*) FROM test SEMI JOIN train USING (uid, timestamp, item_id) UNION ALL SELECT 'val-test', count(*) FROM test SEMI JOIN val USING (uid, timestamp, item_id)")
def _(spark, d):
    p = prepare(spark, d)
    count = lambda name, a, b: splits.leaked(a, b).agg(F.lit(name).alias("pair"), F.count(F.lit(1)).alias("n"))
    return count("train-val", p.val, p.train).union(count("train-test", p.test, p.train)).union(count("val-test", p.test, p.val))


@register("J8_vector_lookup", ", wanted AS (SELECT DISTINCT item_id FROM train WHERE item_id IN (SELECT vec_id FROM embeddings)) " + _positions("vec_id AS item_id", "embeddings WHERE vec_id IN (SELECT item_id FROM wanted)"))
def _(spark, d):
    v = tables.vectors(spark, d)
    return by_position(vectors.lookup(v, cleaning.covered(prepare(spark, d).train, v)), "item_id")


@register("J9_vectors_with_popularity", " " + _positions("item_id, popularity", "pop JOIN embeddings ON vec_id = item_id"))
def _(spark, d):
    v = tables.vectors(spark, d)
    return by_position(vectors.with_popularity(v, cleaning.covered(prepare(spark, d).train, v)), "item_id", "popularity")


@register("J10_coverage", ", i AS (SELECT item_id, count(*) AS n FROM raw GROUP BY 1) SELECT count(*) AS items, count(*) FILTER (item_id IN (SELECT vec_id FROM embeddings)) AS items_known, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (item_id IN (SELECT vec_id FROM embeddings)), 0)::BIGINT AS rows_known FROM i")
def _(spark, d):
    return profile.coverage_counts(prepare(spark, d).raw, tables.vectors(spark, d))


@register("J11_dense_log", "SELECT test.*, dense_id FROM test JOIN id_map ON raw_id = item_id")
def _(spark, d):
    p = prepare(spark, d)
    return splits.to_dense(p.test, p.id_map)


@register("J12_raw_ids", "SELECT dense_id, raw_id FROM id_map")
def _(spark, d):
    p = prepare(spark, d)
    return splits.to_raw(p.id_map.select("dense_id"), p.id_map)


@register("J14_strangers", "SELECT 'user' AS kind, count(*) AS n FROM (SELECT uid FROM test_raw EXCEPT SELECT uid FROM train) UNION ALL SELECT 'item', count(*) FROM (SELECT item_id FROM test_raw EXCEPT SELECT item_id FROM train)")
def _(spark, d):
    p = prepare(spark, d)
    count = lambda name, column: splits.strangers(p.test_raw, p.train, column).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count("user", "uid").union(count("item", "item_id"))


@register("J15_overlap", "SELECT (SELECT count(*) FROM (SELECT uid FROM val_raw INTERSECT SELECT uid FROM test_raw)) AS both, (SELECT count(DISTINCT uid) FROM val_raw) AS left_values, (SELECT count(DISTINCT uid) FROM test_raw) AS right_values")
def _(spark, d):
    p = prepare(spark, d)
    return profile.overlap(p.val_raw, p.test_raw, "uid")


# ---- aggregates


@register("A1_counts", "SELECT count(*) AS rows, count(DISTINCT uid) AS users, count(DISTINCT item_id) AS items FROM fixed")
def _(spark, d):
    return profile.counts(prepare(spark, d).log)


@register("A2_item_counts", "SELECT item_id, count(*) AS count FROM fixed GROUP BY item_id")
def _(spark, d):
    return profile.group_counts(prepare(spark, d).log, "item_id")


@register("A3_histories", "SELECT uid, length, unique_items, round(unique_items / length, 6) AS diversity FROM histories")
def _(spark, d):
    return r6(profile.histories(prepare(spark, d).log), "diversity")


@register("A4_diversity", "SELECT round(avg(unique_items / length), 6) AS mean, count(*) FILTER (unique_items = 1) AS single_item_users FROM histories")
def _(spark, d):
    return profile.histories(prepare(spark, d).log).agg(F.round(F.avg("diversity"), 6).alias("mean"), F.count_if(F.col("unique_items") == 1).alias("single_item_users"))


@register("A5_collisions", "SELECT uid, timestamp, item_id, count(*) AS count FROM exact GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return cleaning.collisions(cleaning.exact_dedup(prepare(spark, d).raw))


_PCT = ", ".join(f"round(quantile_cont(length, {x / 100}), 6) AS p{x}" for x in (25, 50, 75, 90, 95, 99))


@register("A6_A7_length_summary", f"SELECT count(*) AS n, round(avg(length), 6) AS mean, min(length)::DOUBLE AS min, max(length)::DOUBLE AS max, {_PCT} FROM histories")
def _(spark, d):
    return r6(profile.summary(profile.histories(prepare(spark, d).log), "length"), "mean", "p25", "p50", "p75", "p90", "p95", "p99")


@register("A10_gini", ", r AS (SELECT count(*)::DOUBLE AS x, row_number() OVER (ORDER BY count(*)) AS i FROM fixed GROUP BY item_id) SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM r")
def _(spark, d):
    return r6(profile.gini(profile.group_counts(prepare(spark, d).log, "item_id"), "count"), "gini")


@register("A11_head_share", ", r AS (SELECT count(*) AS x, row_number() OVER (ORDER BY count(*) DESC) AS i, count(*) OVER () AS n FROM fixed GROUP BY item_id) SELECT round(sum(x) FILTER (i <= greatest(1, ceil(0.01::DOUBLE * n))) / sum(x), 6) AS head_share FROM r")
def _(spark, d):
    return r6(profile.head_share(profile.group_counts(prepare(spark, d).log, "item_id"), "count", 0.01), "head_share")


@register("A12_weekly", "SELECT week, interactions, active_users FROM weeks")
def _(spark, d):
    return profile.weekly(prepare(spark, d).log)


@register("A13_trend", ", s AS (SELECT interactions, row_number() OVER (ORDER BY week) - 1 AS i FROM weeks), t AS (SELECT count(*) AS n, regr_slope(interactions::DOUBLE, i::DOUBLE) AS slope, avg(interactions) AS mean FROM s) SELECT round(slope, 6) AS slope, round(mean, 6) AS mean, CASE WHEN n < 2 OR abs(slope) <= 0.05 * mean THEN 'flat' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS label FROM t")
def _(spark, d):
    return r6(profile.trend(profile.weekly(prepare(spark, d).log)), "slope", "mean")


@register("A14_profile", "SELECT count(*) AS rows, count(DISTINCT uid) AS users, count(DISTINCT item_id) AS items, min(timestamp) AS ts_min, max(timestamp) AS ts_max, round(avg(is_organic), 6) AS organic_share, round(avg((played_ratio_pct > 100)::INT), 6) AS over_100_share, " + ", ".join(f"round(quantile_cont(played_ratio_pct, {x / 100}), 6) AS played_p{x}" for x in (25, 50, 75, 95)) + " FROM raw")
def _(spark, d):
    return r6(profile.interaction_profile(prepare(spark, d).raw), "organic_share", "over_100_share", "played_p25", "played_p50", "played_p75", "played_p95")


@register("A15_vector_profile", ", i AS (SELECT item_id, count(*) AS n FROM raw GROUP BY 1) SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT min(len(embedding)) FROM embeddings)::INT AS min_dim, (SELECT max(len(embedding)) FROM embeddings)::INT AS max_dim, count(*) AS items, count(*) FILTER (item_id IN (SELECT vec_id FROM embeddings)) AS items_known, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (item_id IN (SELECT vec_id FROM embeddings)), 0)::BIGINT AS rows_known FROM i")
def _(spark, d):
    return profile.vector_profile(prepare(spark, d).raw, tables.vectors(spark, d))


@register("A16_loss_profile", f", {_LOSS} SELECT count(*) AS users, count(*) FILTER (n_after = 0) AS fully_lost, count(*) FILTER (n_after > 0 AND loss >= 0.8::DOUBLE) AS heavy_loss, " + ", ".join(f"round(quantile_cont(loss, {x / 100}) FILTER (n_after > 0), 6) AS loss_p{x}" for x in (25, 50, 75, 95)) + " FROM loss")
def _(spark, d):
    raw = prepare(spark, d).raw
    return r6(cleaning.loss_profile(cleaning.loss_by_user(raw, cleaning.covered(raw, tables.vectors(spark, d))), FIXTURE.heavy_loss), "loss_p25", "loss_p50", "loss_p75", "loss_p95")


@register("A17_cutoff_quality", """, p AS (SELECT *, 'train' AS split FROM train UNION ALL SELECT *, 'val' FROM val_raw UNION ALL SELECT *, 'test' FROM test_raw)
SELECT split, count(*) AS rows, count(DISTINCT uid) AS users, count(DISTINCT item_id) AS items, round(count(*) / (SELECT count(*) FROM p), 6) AS share, round(count(*) / ((max(timestamp) - min(timestamp)) / 86400.0::DOUBLE + 1), 6) AS rows_per_day,
count(DISTINCT uid) FILTER (uid IN (SELECT uid FROM train)) AS users_in_train, count(DISTINCT item_id) FILTER (item_id IN (SELECT item_id FROM train)) AS items_in_train FROM p GROUP BY split""")
def _(spark, d):
    p = prepare(spark, d)
    return r6(profile.cutoff_quality(p.log, p.cut), "share", "rows_per_day")


@register("A18_time_range", "SELECT min(timestamp) AS ts_min, max(timestamp) AS ts_max FROM raw")
def _(spark, d):
    return profile.time_range(prepare(spark, d).raw)


@register("A19_A21_user_items", "SELECT uid, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM test GROUP BY uid")
def _(spark, d):
    return joined(sequences.grouped_items(prepare(spark, d).test), "items")


@register("A20_ordered_items", "SELECT uid, array_to_string(list(dense_id ORDER BY timestamp, item_id), ',') AS items FROM train JOIN id_map ON raw_id = item_id GROUP BY uid")
def _(spark, d):
    p = prepare(spark, d)
    return joined(sequences.sequences(p.train, p.id_map), "items")


@register("A22_total", "SELECT sum(popularity)::BIGINT AS total, (SELECT count(*) FROM train) AS rows FROM pop")
def _(spark, d):
    p = prepare(spark, d)
    pop = profile.popularity(p.train, p.id_map)
    profile.check_total(pop, p.train)
    return pop.agg(F.sum("popularity").alias("total"), F.lit(p.train.count()).alias("rows"))


@register("A23_log_bins", ", c AS (SELECT count(*) AS x FROM fixed GROUP BY item_id) SELECT least(floor(log10(x) / 3 * 60), 59)::INT AS bin, count(*) AS count FROM c WHERE x BETWEEN 1 AND 1000 GROUP BY 1")
def _(spark, d):
    return profile.histogram(profile.group_counts(prepare(spark, d).log, "item_id"), "count", 1, 1000, 60, log_scale=True)


@register("A26_popularity", "SELECT dense_id, popularity FROM id_map JOIN pop ON item_id = raw_id")
def _(spark, d):
    p = prepare(spark, d)
    return profile.popularity(p.train, p.id_map)


# ---- dedup, fixpoint, cutoffs, samples


@register("D1_exact_dedup", "SELECT * FROM exact")
def _(spark, d):
    return cleaning.exact_dedup(prepare(spark, d).raw)


@register("D2_key_dedup", "SELECT * FROM keyed")
def _(spark, d):
    return cleaning.key_dedup(cleaning.exact_dedup(prepare(spark, d).raw))


@register("D3_unique_keys", "SELECT count(*) = 0 AS ok FROM (SELECT 1 FROM keyed GROUP BY uid, timestamp, item_id HAVING count(*) > 1)")
def _(spark, d):
    return cleaning.unique_keys(cleaning.key_dedup(prepare(spark, d).raw))


@register("D4_min_counts", "SELECT * FROM fixed")
def _(spark, d):
    return cleaning.clean(prepare(spark, d).raw, FIXTURE.min_played, FIXTURE.min_user, FIXTURE.min_item, FIXTURE.max_rounds)


_COVERED_ROUNDS = _rounds.replace("f0", "c0")
for _i in range(1, 11):
    _COVERED_ROUNDS = _COVERED_ROUNDS.replace(f" f{_i} ", f" c{_i} ")


@register("J1_D4_covered_log", f", c0 AS MATERIALIZED (SELECT * FROM f0 WHERE item_id IN (SELECT vec_id FROM embeddings)){_COVERED_ROUNDS} SELECT * FROM c10")
def _(spark, d):
    """What the preparation keeps when items need a vector."""
    covered = cleaning.covered(prepare(spark, d).raw, tables.vectors(spark, d))
    return cleaning.clean(covered, FIXTURE.min_played, FIXTURE.min_user, FIXTURE.min_item, FIXTURE.max_rounds)


@register("D15_drift", "SELECT * FROM (SELECT 'rows' AS measure, (SELECT count(*) FROM raw) AS recorded, (SELECT count(*) FROM fixed) AS found UNION ALL SELECT 'users', (SELECT count(DISTINCT uid) FROM raw), (SELECT count(DISTINCT uid) FROM fixed) UNION ALL SELECT 'items', (SELECT count(DISTINCT item_id) FROM raw), (SELECT count(DISTINCT item_id) FROM fixed)) WHERE recorded <> found")
def _(spark, d):
    """The record of the raw log against the log after cleaning: measures that differ."""
    p = prepare(spark, d)
    return profile.drift(profile.counts(p.log), profile.counts(p.raw).first().asDict())


@register("D5_cutoffs", "SELECT t_val, t_test FROM cut")
def _(spark, d):
    cut = prepare(spark, d).cut
    return spark.createDataFrame([(cut.val, cut.test)], "t_val long, t_test long")


@register("D6_group_bounds", f", {_BOUNDS} SELECT lo::BIGINT AS low, hi::BIGINT AS high FROM bounds")
def _(spark, d):
    return spark.createDataFrame([profile.group_bounds(profile.histories(prepare(spark, d).log), "length", FIXTURE.min_subgroup)], "low long, high long")


_N = "greatest({least}, round_even({f}::DOUBLE * (SELECT count(DISTINCT uid) FROM train), 0))"
_SAMPLED = f"""o AS (SELECT uid, row_number() OVER (ORDER BY md5('{FIXTURE.seed}:' || uid), uid) AS i FROM (SELECT DISTINCT uid FROM train)),
big AS MATERIALIZED (SELECT uid FROM o WHERE i <= {_N.format(least=FIXTURE.min_sample, f=FIXTURE.sample_fractions[0])}), small AS MATERIALIZED (SELECT uid FROM o WHERE i <= {_N.format(least=FIXTURE.min_sample, f=FIXTURE.sample_fractions[1])})"""


def _sampled(spark, d):
    return splits.nested_users(prepare(spark, d).train, FIXTURE.sample_fractions, FIXTURE.min_sample, FIXTURE.seed)


@register("D8_nested_users", f", {_SAMPLED} SELECT uid, uid IN (SELECT uid FROM small) AS in_small FROM big")
def _(spark, d):
    big, small = _sampled(spark, d)
    return big.join(small.withColumn("in_small", F.lit(True)), "uid", "left").select("uid", F.coalesce("in_small", F.lit(False)).alias("in_small"))


@register("D9_J5_J6_subsample", f", {_SAMPLED}, t AS MATERIALIZED (SELECT * FROM train WHERE uid IN (SELECT uid FROM big)) SELECT 'train' AS split, * FROM t UNION ALL SELECT 'val', * FROM val WHERE uid IN (SELECT uid FROM big) AND item_id IN (SELECT item_id FROM t) UNION ALL SELECT 'test', * FROM test WHERE uid IN (SELECT uid FROM big) AND item_id IN (SELECT item_id FROM t)")
def _(spark, d):
    p = prepare(spark, d)
    parts = splits.subsample(p.train, p.val, p.test, _sampled(spark, d)[0])
    return tables.scan_union([df.select(F.lit(name).alias("split"), "*") for name, df in zip(("train", "val", "test"), parts, strict=True)])


@register("D10_anchors", f"SELECT vec_id AS item_id FROM embeddings ORDER BY md5('{FIXTURE.seed}:' || vec_id), vec_id LIMIT 20", prep=False)
def _(spark, d):
    return splits.anchors(tables.vectors(spark, d), 20, FIXTURE.seed).select("item_id")


@register("D11_weighted_sample", f", k AS (SELECT item_id, ln((('0x' || substr(md5('{FIXTURE.seed}:' || item_id), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656) / sqrt(popularity + 1) AS key FROM pop) SELECT item_id FROM k ORDER BY key DESC, item_id LIMIT 200")
def _(spark, d):
    pop = profile.group_counts(prepare(spark, d).train, "item_id")
    return splits.weighted_sample(pop, F.sqrt(F.col("count") + 1), 200, FIXTURE.seed).select("item_id")


@register("D12_dense_ids", "SELECT dense_id, raw_id FROM id_map")
def _(spark, d):
    return splits.dense_ids(prepare(spark, d).train)


def _split_checks(val: str, test: str) -> str:
    """Violations of each split invariant, by name."""
    leaked = lambda a, b: f"SELECT 1 FROM {a} SEMI JOIN {b} USING (uid, timestamp, item_id)"
    strangers = lambda a, b, c: f"SELECT {c} FROM {a} EXCEPT SELECT {c} FROM {b}"
    counts = {
        "train before the validation cutoff": "SELECT 1 FROM train, cut WHERE timestamp >= t_val",
        "validation within its window": f"SELECT 1 FROM {val}, cut WHERE timestamp < t_val OR timestamp >= t_test",
        "test after its cutoff": f"SELECT 1 FROM {test}, cut WHERE timestamp < t_test",
        "validation users in train": strangers(val, "train", "uid"), "validation items in train": strangers(val, "train", "item_id"),
        "test users in train": strangers(test, "train", "uid"), "test items in train": strangers(test, "train", "item_id"),
        "no key in train and validation": leaked(val, "train"), "no key in train and test": leaked(test, "train"), "no key in validation and test": leaked(test, val),
        "train has rows": "SELECT 1 WHERE NOT EXISTS (FROM train)", "validation has rows": f"SELECT 1 WHERE NOT EXISTS (FROM {val})", "test has rows": f"SELECT 1 WHERE NOT EXISTS (FROM {test})",
        "no more rows than before": f"SELECT 1 WHERE (SELECT count(*) FROM train) + (SELECT count(*) FROM {val}) + (SELECT count(*) FROM {test}) > (SELECT count(*) FROM fixed)",
    }
    return " UNION ALL ".join(f"SELECT '{val}' AS scope, '{name}' AS name, count(*) AS violations FROM ({sql})" for name, sql in counts.items())


@register("D13_split_invariants", f" {_split_checks('val', 'test')} UNION ALL {_split_checks('val_raw', 'test_raw')}")
def _(spark, d):
    """Of the splits, and of those before the cold filter, which break some."""
    p = prepare(spark, d)
    runs = {"val": (p.val, p.test), "val_raw": (p.val_raw, p.test_raw)}
    return tables.scan_union([splits.split_invariants(p.train, *parts, p.cut, p.log.count()).run(spark).withColumn("scope", F.lit(k)) for k, parts in runs.items()])


def _sample_checks(scope: str, warm: bool) -> str:
    out = []
    for name, outer in (("big", "train"), ("small", "big")):
        mine = f"uid IN (SELECT uid FROM {name})"
        train = f"(SELECT * FROM train WHERE {mine})"
        known = f" AND item_id IN (SELECT item_id FROM train WHERE {mine})" if warm else ""
        val, test = f"(SELECT * FROM val WHERE {mine}{known})", f"(SELECT * FROM test WHERE {mine}{known})"
        checks = {
            "users within the next larger set": f"SELECT uid FROM {name} EXCEPT SELECT uid FROM {outer}",
            "validation items in train": f"SELECT item_id FROM {val} EXCEPT SELECT item_id FROM {train}", "test items in train": f"SELECT item_id FROM {test} EXCEPT SELECT item_id FROM {train}",
            "validation users in train": f"SELECT uid FROM {val} EXCEPT SELECT uid FROM {train}", "no key in train and test": f"SELECT 1 FROM {test} a SEMI JOIN {train} b USING (uid, timestamp, item_id)",
            "enough users": f"SELECT 1 WHERE (SELECT count(*) FROM {name}) < {FIXTURE.min_sample}",
        }
        out += [f"SELECT '{scope}' AS scope, '{name}: {check}' AS name, count(*) AS violations FROM ({sql})" for check, sql in checks.items()]
    return " UNION ALL ".join(out)


@register("D14_sample_invariants", f", {_SAMPLED} {_sample_checks('subsample', True)} UNION ALL {_sample_checks('users only', False)}")
def _(spark, d):
    """Of the subsamples, and of the same users' rows without the items' cut, which break some."""
    p = prepare(spark, d)
    users = dict(zip(("big", "small"), _sampled(spark, d), strict=True))
    least = dict.fromkeys(users, FIXTURE.min_sample)
    mine = lambda df, u: cleaning.keep_users(df, u)
    runs = {
        "subsample": {k: splits.subsample(p.train, p.val, p.test, u) for k, u in users.items()},
        "users only": {k: (mine(p.train, u), mine(p.val, u), mine(p.test, u)) for k, u in users.items()},
    }
    return tables.scan_union([splits.sample_invariants(parts, users, p.train, least).run(spark).withColumn("scope", F.lit(scope)) for scope, parts in runs.items()])


@register("S6_S8_export_import", "SELECT 'train' AS split, * FROM train UNION ALL SELECT 'val', * FROM val UNION ALL SELECT 'test', * FROM test")
def _(spark, d):
    p, path = prepare(spark, d), shared_dir(spark)
    sinks.export_splits({"train": p.train, "val": p.val, "test": p.test}, path)
    return tables.scan_union([df.select(F.lit(k).alias("split"), "*") for k, df in sinks.import_splits(spark, path, ["train", "val", "test"]).items()])


@register("S7_export_report", "SELECT 'val' AS split, 'rows' AS problem, ((SELECT count(*) FROM val) + (SELECT count(*) FROM test))::VARCHAR AS found WHERE EXISTS (FROM test) UNION ALL SELECT 'test', 'extra column week', 'bigint'")
def _(spark, d):
    """An export checked against its manifest after one split got more rows and another a column."""
    p, path = prepare(spark, d), shared_dir(spark)
    sinks.export_splits({"train": p.train, "val": p.val, "test": p.test}, path)
    sinks.write_parquet(tables.scan_union([p.val, p.test]), f"{path}/val")
    sinks.write_parquet(p.test.withColumn("week", F.expr(f"timestamp div {WEEK}")), f"{path}/test")
    return sinks.export_report(spark, path)


@register("D16_frozen_cutoffs", "SELECT CASE WHEN timestamp < t_val THEN 'train' WHEN timestamp < t_test THEN 'val' ELSE 'test' END AS split, count(*) AS rows FROM fixed, cut GROUP BY 1")
def _(spark, d):
    """The log cut by cutoffs that an earlier stage froze."""
    p = prepare(spark, d)
    frozen = splits.read_cutoffs({"temporal_cutoffs": {"T_val_seconds": p.cut.val, "T_test_seconds": p.cut.test}})
    return splits.with_split(p.log, frozen).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


#: Published percentiles of history lengths that ours are held against; the last is out of reach of small tables.
_PUBLISHED = {50: 30.0, 90: 60.0, 99: 10_000.0}


@register("D7_same_magnitude", " UNION ALL ".join(f"SELECT {p} AS percentile, round(quantile_cont(length, {p / 100}), 6) AS value, quantile_cont(length, {p / 100}) / {v}::DOUBLE BETWEEN 0.1 AND 10 AS same FROM histories" for p, v in _PUBLISHED.items()))
def _(spark, d):
    lengths = profile.histories(prepare(spark, d).log)
    row = lengths.agg(profile.percentiles("length", [p / 100 for p in _PUBLISHED])).first()[0]
    return r6(spark.createDataFrame([(p, float(x), profile.same_magnitude(x, v)) for (p, v), x in zip(_PUBLISHED.items(), row, strict=True)], "percentile int, value double, same boolean"), "value")


@register("S9_replaced_table", "SELECT * FROM val UNION ALL SELECT * FROM test")
def _(spark, d):
    """A table written twice: the second write takes the place of the first."""
    p, path = prepare(spark, d), f"{shared_dir(spark)}/table"
    sinks.write_parquet(p.train, path)
    sinks.write_parquet(tables.scan_union([p.val, p.test]), path)
    return spark.read.parquet(path)


@register("S9_versioned_table", "SELECT 1 AS version, * FROM val UNION ALL SELECT 2, * FROM test")
def _(spark, d):
    """Two versions of a table, the last and the one before."""
    p, path = prepare(spark, d), f"{shared_dir(spark)}/table"
    numbers = [sinks.write_version(df, path) for df in (p.val, p.test)]
    return tables.scan_union([sinks.read_version(spark, path, n).select(F.lit(n).alias("version"), "*") for n in numbers])


_STAGES = {"raw": "raw", "cleaned": "fixed", "train": "train", "val before cold filter": "val_raw", "test before cold filter": "test_raw", "val": "val", "test": "test"}


@register("S11_stage_report", " UNION ALL ".join(f" SELECT '{name}' AS stage, count(*) AS rows, count(DISTINCT uid) AS users, count(DISTINCT item_id) AS items FROM {t}" for name, t in _STAGES.items()))
def _(spark, d):
    return report(prepare(spark, d))


@register("S13_csv", "SELECT week::INT AS week, interactions::INT AS interactions, active_users::INT AS active_users FROM weeks")
def _(spark, d):
    """The weekly series through a CSV file."""
    path = shared_dir(spark)
    sinks.write_csv(profile.weekly(prepare(spark, d).log), path)
    return spark.read.option("header", True).schema("week int, interactions int, active_users int").csv(path)


# ---- ranking

_DOT = f"round({DOT.format(a='u.embedding', b='v.embedding')}, 10)"


@register("R1_rank_items", f"WITH s AS (SELECT u.vec_id AS uid, v.vec_id AS item_id, {_DOT} AS score FROM embeddings u, embeddings v) SELECT uid, rank::INT AS rank, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 10", prep=False)
def _(spark, d):
    v = tables.vectors(spark, d)
    return r6(ranking.rank_blocks(v.withColumnRenamed("item_id", "uid"), v, 10), "score")


@register("R1_J13_rank_pairs", f"WITH s AS (SELECT u.vec_id AS uid, v.vec_id AS item_id, {_DOT} AS score FROM embeddings u, embeddings v) SELECT uid, rank::INT AS rank, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 10", prep=False)
def _(spark, d):
    v = tables.vectors(spark, d)
    return r6(ranking.rank_blocks(v.withColumnRenamed("item_id", "uid"), v, 10, item_bytes=32_768, user_rows=150), "score")


_POPULAR = "top AS (SELECT item_id, popularity, row_number() OVER (ORDER BY popularity DESC, item_id) AS rank FROM pop QUALIFY rank <= 100), ranked AS MATERIALIZED (SELECT uid, rank::INT AS rank, item_id, popularity::DOUBLE AS score FROM (SELECT DISTINCT uid FROM test), top)"


def _popular(spark, d):
    p = prepare(spark, d)
    pop = profile.group_counts(p.train, "item_id").withColumnRenamed("count", "popularity")
    return ranking.rank_popular(pop, p.test, 100)


@register("R2_mostpop", f", {_POPULAR} SELECT * FROM ranked")
def _(spark, d):
    return _popular(spark, d)


def _random_sql(seed: int) -> str:
    """random{seed}: the random ranking of each test user."""
    return f"""draws{seed} AS (SELECT uid, draw, md5('{seed}:' || uid || ':' || draw) AS h FROM (SELECT DISTINCT uid FROM test), range(60) t(draw)),
drawn{seed} AS (SELECT uid, min(draw) AS draw, floor(('0x' || substr(h, 1, 12))::BIGINT::DOUBLE / 281474976710656 * n)::BIGINT AS item_id FROM draws{seed}, n GROUP BY uid, item_id),
random{seed} AS MATERIALIZED (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY draw) AS rank, item_id FROM drawn{seed} QUALIFY rank <= 10)"""


_RANDOM = f"n AS (SELECT count(*) AS n FROM id_map), {_random_sql(FIXTURE.seed)}"


def _random(spark, d, seed=FIXTURE.seed):
    p = prepare(spark, d)
    return ranking.rank_random(p.test, p.id_map.count(), 10, seed)


@register("R3_random", f", {_RANDOM} SELECT uid, rank::INT AS rank, item_id, round(1 - rank / 11, 6) AS score FROM random{FIXTURE.seed}")
def _(spark, d):
    return r6(_random(spark, d), "score")


_UNIT = "WITH e AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, embedding FROM embeddings), v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / CASE WHEN n > 0 THEN n ELSE 1 END) AS embedding FROM e)"


@register("R4_cosine_neighbours", f"{_UNIT}, a AS (SELECT vec_id, embedding FROM v ORDER BY md5('{FIXTURE.seed}:' || vec_id), vec_id LIMIT 20), s AS (SELECT u.vec_id AS item_id, v.vec_id AS neighbour, {_DOT} AS score FROM a u, v WHERE u.vec_id <> v.vec_id) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neighbour)::INT AS rank, neighbour, round(score, 6) AS score FROM s QUALIFY rank <= 5", prep=False)
def _(spark, d):
    v = tables.vectors(spark, d)
    return r6(vectors.cosine_neighbours(splits.anchors(v, 20, FIXTURE.seed), v, 5), "score")


@register("R5_sample_neighbours", f"{_UNIT}, a AS MATERIALIZED (SELECT vec_id, embedding FROM v ORDER BY md5('{FIXTURE.seed}:' || vec_id), vec_id LIMIT 100), s AS (SELECT u.vec_id AS item_id, v.vec_id AS neighbour, {_DOT} AS score FROM a u, a v WHERE u.vec_id <> v.vec_id) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neighbour)::INT AS rank, neighbour, round(score, 6) AS score FROM s QUALIFY rank <= 5", prep=False)
def _(spark, d):
    some = splits.anchors(tables.vectors(spark, d), 100, FIXTURE.seed)
    return r6(vectors.cosine_neighbours(some, some, 5), "score")


@register("R6_normalised", f"{_UNIT} " + _positions("vec_id AS item_id", "v"), prep=False)
def _(spark, d):
    return by_position(tables.vectors(spark, d).select("item_id", vectors.normalised(F.col("vec")).alias("vec")), "item_id")


@register("R7_A8_norm_stats", f"{_UNIT} SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(min(n), 6) AS min, round(max(n), 6) AS max, " + ", ".join(f"round(quantile_cont(n, {x / 100}), 6) AS p{x}" for x in (1, 5, 50, 95, 99)) + " FROM e", prep=False)
def _(spark, d):
    return r6(vectors.norm_stats(tables.vectors(spark, d)), "mean", "std", "min", "max", "p1", "p5", "p50", "p95", "p99")


@register("R8_pca_variance")
def _(spark, d):
    return r6(vectors.principal_variance(tables.vectors(spark, d), 3), "share")


_CENTRED = "m AS (SELECT pos, avg(x) AS m FROM e GROUP BY pos), c AS MATERIALIZED (SELECT vec_id, pos, x - m AS x FROM e JOIN m USING (pos)), cov AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) AS v FROM c a JOIN c b USING (vec_id) GROUP BY ALL)"


@register("R8_pca_moments", f"WITH e AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), {_CENTRED}, t AS (SELECT sum(v) FILTER (i = j) AS trace FROM cov) SELECT 64::BIGINT AS components, 1.0::DOUBLE AS total, round((SELECT sum(v * v) FROM cov) / (trace * trace), 6) AS squares, round((SELECT sum(a.v * b.v * c.v) FROM cov a JOIN cov b ON a.j = b.i JOIN cov c ON b.j = c.i AND c.j = a.i) / (trace * trace * trace), 6) AS cubes FROM t", prep=False)
def _(spark, d):
    """Sums of powers of all variance shares, which are traces of powers of the covariance."""
    shares = vectors.principal_variance(tables.vectors(spark, d), 64)
    return r6(shares.agg(F.count(F.lit(1)).alias("components"), F.sum("share").alias("total"), F.sum(F.col("share") ** 2).alias("squares"), F.sum(F.col("share") ** 3).alias("cubes")), "total", "squares", "cubes")


@register("R9_cut_to_targets", f", {_POPULAR} SELECT * FROM ranked WHERE uid IN (SELECT uid FROM test)")
def _(spark, d):
    return ranking.cut_to_targets(_popular(spark, d), prepare(spark, d).test)


_HITS = f"{_POPULAR}, h AS MATERIALIZED (SELECT r.*, (t.uid IS NOT NULL)::INT AS hit FROM ranked r LEFT JOIN (SELECT DISTINCT uid, item_id FROM test) t USING (uid, item_id)), nt AS (SELECT uid, count(DISTINCT item_id) AS n FROM test GROUP BY uid)"


@register("R10_hits", f", {_HITS} SELECT * FROM h")
def _(spark, d):
    return ranking.hits(_popular(spark, d), prepare(spark, d).test)


@register("R11_log_popularity", "SELECT item_id, round(ln(1 + popularity), 6) AS log_popularity FROM pop")
def _(spark, d):
    return r6(ranking.log_popularity(profile.group_counts(prepare(spark, d).train, "item_id").withColumnRenamed("count", "popularity")), "log_popularity")


# ---- metrics and tests


def _user_sql(k: int) -> str:
    top = f"FILTER (rank <= {k})"
    ideal = f"list_sum(list_transform(range(1, least(any_value(n), {k}) + 1), lambda i: 1 / log2(i + 1)))"
    dcg = f"coalesce(sum(hit / log2(rank + 1)) {top}, 0)"
    return (
        f"sum(hit) {top} / least(any_value(n), {k}) AS recall_{k}, sum(hit) {top} / {k} AS precision_{k}, (max(hit) {top})::DOUBLE AS hitrate_{k}, "
        f"coalesce(1 / min(rank) FILTER (rank <= {k} AND hit = 1), 0) AS mrr_{k}, {dcg} AS dcg_{k}, {dcg} / {ideal} AS ndcg_{k}"
    )


_NAMES = [f"{m}_{k}" for k in FIXTURE.ks for m in ("recall", "precision", "hitrate", "mrr", "dcg", "ndcg")]
_USERS = f"{_HITS}, users AS MATERIALIZED (SELECT uid, {', '.join(map(_user_sql, FIXTURE.ks))} FROM h JOIN nt USING (uid) GROUP BY uid)"
_METRICS = [f"{m}@{k}" for k in FIXTURE.ks for m in metrics.METRICS]


@register("M1_M8_mostpop_metrics", f", {_USERS} " + " UNION ALL ".join([*(f"SELECT '{n.split('_')[0]}' AS metric, {n.split('_')[1]}::INT AS k, round(avg({n}), 6) AS value FROM users" for n in _NAMES), *(f"SELECT 'coverage', {k}, round(count(DISTINCT item_id) FILTER (rank <= {k}) / (SELECT count(*) FROM id_map), 6) FROM ranked" for k in FIXTURE.ks)]))
def mostpop_metrics(spark, d):
    p = prepare(spark, d)
    names = [*_METRICS, *(f"coverage@{k}" for k in FIXTURE.ks)]
    return r6(metrics.evaluate(_popular(spark, d), p.test, p.id_map.count(), names), "value")


@register("M9_per_user", f", {_USERS} SELECT uid, " + ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES) + " FROM users")
def _(spark, d):
    return r6(metrics.per_user(_popular(spark, d), prepare(spark, d).test, _METRICS), *_NAMES)


@register("M10_user_percentiles", f", {_USERS} SELECT round(quantile_cont(recall_100, 0.1), 6) AS p10, round(quantile_cont(recall_100, 0.5), 6) AS p50, round(quantile_cont(recall_100, 0.9), 6) AS p90 FROM users")
def _(spark, d):
    return r6(metrics.user_percentiles(metrics.per_user(_popular(spark, d), prepare(spark, d).test, ["recall@100"]), "recall_100"), "p10", "p50", "p90")


def _random_users_sql(seed: int) -> str:
    """b{seed}: recall_10 and hitrate_10 of the random ranking by user."""
    return f"""b{seed} AS MATERIALIZED (SELECT r.uid, count(t.uid) / least(any_value(n), 10) AS recall_10, (count(t.uid) > 0)::DOUBLE AS hitrate_10 FROM random{seed} r JOIN id_map ON dense_id = item_id
LEFT JOIN (SELECT DISTINCT uid, item_id FROM test) t ON t.uid = r.uid AND t.item_id = raw_id JOIN nt ON nt.uid = r.uid GROUP BY r.uid)"""


_PAIRS = f"{_USERS}, {_RANDOM}, {_random_users_sql(FIXTURE.seed)}, pairs AS MATERIALIZED (SELECT uid, users.recall_10 AS a, b{FIXTURE.seed}.recall_10 AS b FROM users JOIN b{FIXTURE.seed} USING (uid))"
_TWO = ["recall@10", "hitrate@10"]


def _random_users(spark, d, seed=FIXTURE.seed):
    p = prepare(spark, d)
    raw = _random(spark, d, seed).withColumnRenamed("item_id", "dense_id").join(p.id_map, "dense_id").select("uid", "rank", F.col("raw_id").alias("item_id"), "score")
    return metrics.per_user(raw, p.test, _TWO)


def _popular_users(spark, d):
    return metrics.per_user(_popular(spark, d), prepare(spark, d).test, _TWO)


def _pairs(spark, d):
    a, b = _popular_users(spark, d), _random_users(spark, d)
    return a.select("uid", F.col("recall_10").alias("a")).join(b.select("uid", F.col("recall_10").alias("b")), "uid")


#: Two models, and two seeds of the one that has seeds.
_SEEDS = (FIXTURE.seed, FIXTURE.seed + 1)
_RUNS = f"{_USERS}, {_RANDOM}, {_random_sql(_SEEDS[1])}, " + ", ".join(map(_random_users_sql, _SEEDS)) + ", runs AS MATERIALIZED (SELECT 'mostpop' AS model, 0 AS seed, uid, recall_10, hitrate_10 FROM users" + "".join(f" UNION ALL SELECT 'random', {x}, uid, recall_10, hitrate_10 FROM b{x}" for x in _SEEDS) + ")"


def _runs(spark, d):
    mark = lambda df, model, seed: df.select(F.lit(model).alias("model"), F.lit(seed).alias("seed"), "uid", "recall_10", "hitrate_10")
    return tables.scan_union([mark(_popular_users(spark, d), "mostpop", 0), *[mark(_random_users(spark, d, x), "random", x) for x in _SEEDS]])


_WILCOXON = """{name}s AS (SELECT d FROM {source} WHERE d <> 0), {name}r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM {name}s),
{name}w AS (SELECT count(*) AS n, coalesce(least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)), 0) AS w, sum((t * t - 1)::DOUBLE) AS ties FROM {name}r),
{name}z AS (SELECT n, w, abs(w - n::DOUBLE * (n + 1) / 4) / sqrt(2 * (n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48)) AS z FROM {name}w),
{name}p AS (SELECT n, w, CASE WHEN z > 4 THEN 0 ELSE least(1, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda i: CASE WHEN z > 0 THEN (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln(z) - lgamma(i + 1)) / (2 * i + 1) ELSE 0 END))) END AS p FROM {name}z)"""


@register("T1_wilcoxon", f", {_PAIRS}, da AS (SELECT a - b AS d FROM pairs), {_WILCOXON.format(name='first', source='da')} SELECT n, round(w, 6) AS w, round(p, 5) AS p FROM firstp")
def _(spark, d):
    return r6(significance.wilcoxon(_pairs(spark, d)), "w").withColumn("p", F.round("p", 5))


@register("T2_bonferroni", f", {_USERS}, {_RANDOM}, {_random_users_sql(FIXTURE.seed)}, " + ", ".join(f"d{m} AS (SELECT users.{m}_10 - b{FIXTURE.seed}.{m}_10 AS d FROM users JOIN b{FIXTURE.seed} USING (uid)), " + _WILCOXON.format(name=m, source=f"d{m}") for m in ("recall", "hitrate")) + " SELECT metric, n, round(p, 5) AS p, p < 0.05::DOUBLE / 2 AS significant FROM (SELECT 'recall' AS metric, n, p FROM recallp UNION ALL SELECT 'hitrate', n, p FROM hitratep)")
def _(spark, d):
    a, b = _popular_users(spark, d), _random_users(spark, d)
    both = materialise(a.join(b.withColumnsRenamed({"recall_10": "recall_b", "hitrate_10": "hitrate_b"}), "uid"))
    test = lambda m: significance.wilcoxon(both.select(F.col(f"{m}_10").alias("a"), F.col(f"{m}_b").alias("b"))).select(F.lit(m).alias("metric"), "n", "p")
    return significance.bonferroni(test("recall").unionByName(test("hitrate"))).withColumn("p", F.round("p", 5))


@register("T3_bootstrap", f""", {_USERS}, x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY uid) - 1 AS pos, recall_10 AS x, count(*) OVER () AS n FROM users),
m AS (SELECT draw // n AS resample, sum(x) / any_value(n) AS m FROM (SELECT draw, n, floor(('0x' || substr(md5('{FIXTURE.seed}:' || draw), 1, 12))::BIGINT::DOUBLE / 281474976710656 * n)::BIGINT AS pos FROM (SELECT unnest(range(100 * (SELECT any_value(n) FROM x))) AS draw), (SELECT any_value(n) AS n FROM x)) JOIN (SELECT pos, x FROM x) USING (pos) GROUP BY 1)
SELECT round((SELECT avg(x) FROM x), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def _(spark, d):
    users = metrics.per_user(_popular(spark, d), prepare(spark, d).test, ["recall@10"])
    return r6(significance.bootstrap_mean(users.select(F.col("uid").alias("id"), F.col("recall_10").alias("x")), 100, FIXTURE.seed), "mean", "low", "high")


@register("T4_seed_averaged", f", {_RUNS} SELECT model, uid, round(avg(recall_10), 6) AS recall_10, round(avg(hitrate_10), 6) AS hitrate_10 FROM runs GROUP BY ALL")
def _(spark, d):
    return r6(significance.seed_averaged(_runs(spark, d), ["recall_10", "hitrate_10"]), "recall_10", "hitrate_10")


@register("A24_over_seeds", f", {_RUNS}, v AS (SELECT model, seed, avg(recall_10) AS recall, avg(hitrate_10) AS hitrate FROM runs GROUP BY ALL), l AS (SELECT model, 'recall' AS metric, recall AS value FROM v UNION ALL SELECT model, 'hitrate', hitrate FROM v) SELECT model, metric, 10 AS k, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(value) AS n FROM l GROUP BY ALL")
def _(spark, d):
    means = _runs(spark, d).groupBy("model", "seed").agg(F.avg("recall_10").alias("recall"), F.avg("hitrate_10").alias("hitrate"))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(10).alias("k"), F.col(m).alias("value")) for m in ("recall", "hitrate")])).alias("x")
    return r6(profile.over_seeds(means.select("model", "seed", rows).select("model", "seed", "x.*")), "mean", "std")


@register("A25_seed_table", f", {_RUNS}, v AS (SELECT model, seed, avg(recall_10) AS recall FROM runs GROUP BY ALL) SELECT 'recall' AS metric, 10 AS k, " + ", ".join(f"round(avg(recall) FILTER (model = '{m}'), 6) AS {m}_mean, round(coalesce(stddev_samp(recall) FILTER (model = '{m}'), 0), 6) AS {m}_std" for m in ("mostpop", "random")) + " FROM v")
def _(spark, d):
    means = _runs(spark, d).groupBy("model", "seed").agg(F.avg("recall_10").alias("value")).select("model", "seed", F.lit("recall").alias("metric"), F.lit(10).alias("k"), "value")
    return r6(profile.seed_table(means, ["mostpop", "random"]), "mostpop_mean", "mostpop_std", "random_mean", "random_std")


@register("T5_by_history", f", {_USERS}, q AS (SELECT recall_100, ntile(4) OVER (ORDER BY length, uid) AS segment FROM users JOIN histories USING (uid)) SELECT segment::INT AS segment, count(*) AS users, round(avg(recall_100), 6) AS value FROM q GROUP BY segment")
def _(spark, d):
    p = prepare(spark, d)
    users = metrics.per_user(_popular(spark, d), p.test, ["recall@100"])
    return r6(significance.by_history(users, profile.histories(p.log), "recall_100"), "value")


# ---- sequences and what feeds training

_SEQ = "both_splits AS (SELECT * FROM train UNION ALL SELECT * FROM val), seq AS MATERIALIZED (SELECT uid, list(dense_id ORDER BY timestamp, item_id) AS items FROM {log} JOIN id_map ON raw_id = item_id GROUP BY uid)"


def _seqs(spark, d):
    p = prepare(spark, d)
    return sequences.sequences(p.train, p.id_map)


@register("Q1_Q2_test_prefixes", f", {_SEQ.format(log='both_splits')} SELECT uid, array_to_string(items, ',') AS items FROM seq")
def _(spark, d):
    p = prepare(spark, d)
    return joined(sequences.prefixes(p.train, p.val, p.id_map, "test", p.cut.test), "items")


@register("Q3_next_items", f", {_SEQ.format(log='train')} SELECT uid, array_to_string(items[1:-2][-10:], ',') AS items, array_to_string(items[2:][-10:], ',') AS positives FROM seq WHERE len(items) >= 2")
def _(spark, d):
    return joined(sequences.next_items(_seqs(spark, d), 10), "items", "positives")


@register("Q4_eval_state", f", {_SEQ.format(log='train')} SELECT uid, array_to_string(items[-10:], ',') AS items FROM seq WHERE uid IN (SELECT uid FROM test)")
def _(spark, d):
    return joined(sequences.eval_state(_seqs(spark, d), 10, prepare(spark, d).test), "items")


@register("Q5_flattened", f", {_SEQ.format(log='train')} SELECT uid, len(items)::INT AS length, (generate_subscripts(items, 1) - 1)::INT AS pos, unnest(items) AS item FROM seq")
def _(spark, d):
    return sequences.flattened(_seqs(spark, d))


@register("Q6_Q7_padded", f", {_SEQ.format(log='train')}, s AS (SELECT uid, items[-10:] AS s FROM seq) SELECT uid, array_to_string(list_resize(s, 10, 0), ',') AS padded, array_to_string(list_transform(range(1, 11), lambda j: j <= len(s)), ',') AS mask, array_to_string(list_transform(range(1, 11), lambda j: greatest(len(s) - j, 0)), ',') AS positions FROM s")
def _(spark, d):
    return joined(sequences.padded(sequences.eval_state(_seqs(spark, d), 10), 10), "padded", "mask", "positions")


@register("Q8_aligned_vectors", ", a AS (SELECT dense_id, coalesce(embedding, list_transform(range(64), lambda x: 0::FLOAT)) AS vec FROM id_map LEFT JOIN embeddings ON vec_id = raw_id) " + _positions("dense_id", "a", "vec"))
def _(spark, d):
    return by_position(vectors.aligned(tables.vectors(spark, d), prepare(spark, d).id_map, 64), "dense_id")


@register("N6_log_q", "SELECT dense_id, round(ln(greatest(popularity / (SELECT count(*) FROM train), 1e-9)), 6) AS log_q FROM id_map JOIN pop ON item_id = raw_id")
def _(spark, d):
    p = prepare(spark, d)
    return r6(neural.log_q(profile.popularity(p.train, p.id_map)), "log_q")


@register("N7_capped_positions", f", {_SEQ.format(log='train')}, f AS (SELECT uid, len(items)::INT AS length, (generate_subscripts(items, 1) - 1)::INT AS pos, unnest(items) AS item FROM seq) SELECT * FROM f ORDER BY md5('{FIXTURE.seed}:' || uid || ':' || pos), uid, pos LIMIT 1000")
def _(spark, d):
    return neural.capped_positions(sequences.flattened(_seqs(spark, d)), 1000, FIXTURE.seed)


def _plain_encoder(dim: int) -> neural.Encoder:
    """An encoder without layers: a user is their newest item's vector, normalised."""
    return neural.Encoder(np.zeros((10, dim)), (np.ones(dim), np.zeros(dim)), (), 1)


def _encoded(spark, d):
    p = prepare(spark, d)
    items = vectors.aligned(tables.vectors(spark, d), p.id_map, 64)
    return p, items, _plain_encoder(64)


_ENCODED = f""", {_SEQ}, iv AS MATERIALIZED (SELECT dense_id, coalesce(embedding, list_transform(range(64), lambda x: 0::FLOAT))::DOUBLE[] AS v FROM id_map LEFT JOIN embeddings ON vec_id = raw_id),
nv AS MATERIALIZED (SELECT dense_id, list_transform(v, lambda x: (x - list_avg(v)) / sqrt(list_avg(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))) + 1e-9::DOUBLE)) AS v FROM iv),
uv AS MATERIALIZED (SELECT uid, v FROM seq JOIN nv ON dense_id = items[-1])"""


@register("N4_N10_user_vectors", _ENCODED.format(log="train") + ", o AS (SELECT uid, v FROM uv SEMI JOIN test USING (uid)) " + "SELECT uid, (generate_subscripts(v, 1) - 1)::INT AS pos, round(unnest(v)::FLOAT::DOUBLE, 4) AS value FROM o")
def _(spark, d):
    """Test users' vectors, written and read back."""
    p, items, model = _encoded(spark, d)
    path = shared_dir(spark)
    neural.extract({"test": _seqs(spark, d).join(p.test.select("uid").distinct(), "uid", "left_semi")}, items, model, path)
    rows = sinks.read_vectors(spark, path, "test").select("uid", F.posexplode("vec").alias("pos", "x"))
    return rows.select("uid", "pos", F.round(F.col("x").cast("double"), 4).alias("value"))


@register("N9_encoder_metrics", _ENCODED.format(log="train") + f""", tt AS MATERIALIZED (SELECT DISTINCT uid, dense_id AS item_id FROM test JOIN id_map ON raw_id = item_id),
s AS (SELECT uid, dense_id AS item_id, round({DOT.format(a="uv.v", b="iv.v")}, 10) AS score FROM uv SEMI JOIN tt USING (uid), iv), top AS MATERIALIZED (SELECT uid, item_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 10),
h AS (SELECT uid, count(tt.uid) AS hits FROM top LEFT JOIN tt USING (uid, item_id) GROUP BY uid), nt AS (SELECT uid, count(*) AS n FROM tt GROUP BY uid)
SELECT 'recall' AS metric, 10 AS k, round(avg(hits / least(n, 10)), 6) AS value FROM h JOIN nt USING (uid) UNION ALL SELECT 'hitrate', 10, round(avg((hits > 0)::INT), 6) FROM h UNION ALL SELECT 'coverage', 10, round((SELECT count(DISTINCT item_id) FROM top) / (SELECT count(*) FROM id_map), 6)""")
def _(spark, d):
    p, items, model = _encoded(spark, d)
    goal = splits.to_dense(p.test, p.id_map).select("uid", F.col("dense_id").alias("item_id"))
    return r6(neural.evaluate(_seqs(spark, d), items, model, goal, ["recall@10", "hitrate@10", "coverage@10"])[0], "value")
