"""Registered queries on the small tables: known figures, and a sample of them against SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.config import FIXTURE
from tidemark.operators import cleaning, metrics, profile, ranking, splits
from tidemark.plans.prepare import prepare
from tidemark.plans.queries import QUERIES, SQL
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_known_figures_with_coverage_filter(spark):
    raw = tables.interactions(spark, SF)
    assert tuple(profile.counts(raw).first()) == (6000, 150, 200)
    log = cleaning.covered(raw, tables.vectors(spark, SF))
    assert log.count() == 6000
    exact = cleaning.exact_dedup(log)
    keyed = cleaning.key_dedup(exact)
    heard = cleaning.played(keyed, FIXTURE.min_played)
    assert (exact.count(), cleaning.collisions(exact).count(), keyed.count(), heard.count()) == (5998, 55, 5942, 3104)
    fixed, rounds = cleaning.min_counts(heard, 5, 5)
    assert tuple(profile.counts(fixed).first()) == (3102, 149, 200) and rounds == 2
    cut = splits.choose_cutoffs(fixed, FIXTURE.val_seconds, FIXTURE.test_seconds, 100)
    assert (cut.val, cut.test) == (173_145_600, 190_425_600)
    train, val, test = splits.split(fixed, cut)
    assert (train.count(), val.count(), test.count()) == (2637, 226, 239)
    assert splits.warm(test, train).count() == 239
    pop = profile.group_counts(train, "item_id").withColumnRenamed("count", "popularity")
    got = {r.metric: r.value for r in metrics.evaluate(ranking.rank_popular(pop, test, 10), test, 200, ["recall@10", "ndcg@10", "hitrate@10"]).collect()}
    assert got == pytest.approx({"recall": 0.070431, "ndcg": 0.038334, "hitrate": 0.202703}, abs=1e-6)


def test_splits_are_prepared_once_and_hold(spark):
    p = prepare(spark, SF)
    assert prepare(spark, SF) is p
    splits.split_invariants(p.train, p.val, p.test, p.cut, p.log.count()).demand(spark)
    assert splits.check_dense(p.id_map)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r.value <= 5 for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["D4_min_counts", "J3_loss_by_user", "A10_gini", "A17_cutoff_quality", "M1_M8_mostpop_metrics", "M9_per_user", "T1_wilcoxon", "Q3_next_items", "R1_rank_items"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    want = con.sql(SQL[name])
    columns = sorted(want.columns)
    have = sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect())
    rows = sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert len(have) == len(rows) > 0
    for a, b in zip(have, rows, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, (int, float)) for x in b) else a == b or all(x == y or y == pytest.approx(x, abs=2e-6) for x, y in zip(a, b, strict=True))
