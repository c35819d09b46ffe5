"""The preparation stages in their order, each written out for the ones after it."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIXTURE, Settings
from ..operators import cleaning, profile, splits
from ..sources import schema, tables
from ..sources.work import Scratch, materialise, owning


@dataclass(frozen=True)
class Prepared:
    """The log at each stage, its cutoffs, the splits before and after the cold filter, and the id map."""

    raw: DataFrame
    log: DataFrame
    cut: splits.Cutoffs
    train: DataFrame
    val_raw: DataFrame
    test_raw: DataFrame
    val: DataFrame
    test: DataFrame
    id_map: DataFrame


#: What was prepared, and its tables: they are the memo's, no caller's.
_done: dict[tuple, tuple[Prepared, Scratch]] = {}
_one_at_a_time = threading.Lock()


def _changed(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """When each table that prepare() reads was changed."""
    at = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem", "part", "embeddings")]
    return tuple(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() for p in at)


def prepare(spark: SparkSession, sf_dir: str, how: Settings = FIXTURE) -> Prepared:
    """Validate, clean, cut and split the interaction log of ``sf_dir``; once a session while its tables stay as they are."""
    key = (spark.sparkContext.applicationId, sf_dir, how, _changed(spark, sf_dir))
    with _one_at_a_time:
        if key not in _done:
            with owning(Scratch(spark)) as tables_of_memo:
                _done[key] = _prepared(spark, sf_dir, how), tables_of_memo
        return _done[key][0]


def _prepared(spark: SparkSession, sf_dir: str, how: Settings) -> Prepared:
    raw = schema.validate(materialise(tables.interactions(spark, sf_dir)), tables.INTERACTIONS, f"{sf_dir} interactions")
    known = cleaning.covered(raw, tables.vectors(spark, sf_dir)) if how.need_vectors else raw
    log = cleaning.clean(known, how.min_played, how.min_user, how.min_item, how.max_rounds)
    cut = splits.choose_cutoffs(log, how.val_seconds, how.test_seconds, how.min_window_rows)
    train, val_raw, test_raw = splits.split(log, cut)
    train = materialise(train)
    val, test = materialise(splits.warm(val_raw, train)), materialise(splits.warm(test_raw, train))
    return Prepared(raw, log, cut, train, val_raw, test_raw, val, test, materialise(splits.dense_ids(train)))


def forget() -> None:
    """Delete what prepare() keeps, tables and memo alike."""
    with _one_at_a_time:
        while _done:
            _done.popitem()[1][1].close()


def report(p: Prepared) -> DataFrame:
    """(stage, rows, users, items) of the log at each stage; sinks.markdown() makes a page of it."""
    stages = {"raw": p.raw, "cleaned": p.log, "train": p.train, "val before cold filter": p.val_raw, "test before cold filter": p.test_raw, "val": p.val, "test": p.test}
    return tables.scan_union([profile.counts(df).withColumn("stage", F.lit(name)) for name, df in stages.items()])
