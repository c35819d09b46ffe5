"""Sinks: Parquet by staging and rename, split exports with a manifest, JSON, Markdown and CSV reports."""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import discard


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write to a staging folder beside ``path``, then move the old table aside, the new one in, and delete the old.

    A reader finds the old table or the new one, except in the moment between the two moves.
    If the second fails the old table is moved back; if the driver dies between them, the next
    write() moves it back first.
    """
    spark, staging, aside = df.sparkSession, f"{path}.staging", f"{path}.old"
    fs, target = _fs(spark, path)
    move = lambda a, b: fs.rename(_fs(spark, a)[1], _fs(spark, b)[1])
    if fs.exists(_fs(spark, aside)[1]):
        discard(spark, aside) if fs.exists(target) else move(aside, path)
    df.write.mode("overwrite").option("compression", compression).parquet(staging)
    if fs.exists(target) and not move(path, aside):
        raise OSError(f"cannot rename {path} to {aside}")
    if not move(staging, path):
        if fs.exists(_fs(spark, aside)[1]):
            move(aside, path)
        raise OSError(f"cannot rename {staging} to {path}")
    discard(spark, aside)


def write_version(df: DataFrame, path: str, compression: str = "zstd") -> int:
    """Write ``df`` as the next version of the table at ``path``; readers see the one before until it is whole. Its number.

    A version is a folder of its own; a small file ``pointers``/number names it and is made last,
    by a create that fails if another writer has the number, who then takes the next. At no
    moment is there no table. The version before stays for its readers, older ones go.
    """
    spark = df.sparkSession
    fs, pointers = _fs(spark, f"{path}/pointers")
    data = f"{path}/data/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(data)
    number = max(_versions(spark, path), default=0) + 1
    fs.mkdirs(pointers)
    while True:
        at = _fs(spark, f"{path}/pointers/{number:012d}")[1]
        try:
            out = fs.create(at, False)
            break
        except Py4JJavaError:
            if not fs.exists(at):
                raise
            number += 1
    out.write(bytearray(data.rsplit("/", 1)[1].encode()))
    out.close()
    for old in sorted(_versions(spark, path))[:-2]:
        discard(spark, _version_data(spark, path, old))
        discard(spark, f"{path}/pointers/{old:012d}")
    return number


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, pointers = _fs(spark, f"{path}/pointers")
    return [int(f.getPath().getName()) for f in fs.listStatus(pointers) if f.getLen()] if fs.exists(pointers) else []


def _version_data(spark: SparkSession, path: str, number: int) -> str:
    return f"{path}/data/" + spark.read.text(f"{path}/pointers/{number:012d}").first()[0]


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The last whole version of a table of write_version(), or the one of that number."""
    have = _versions(spark, path)
    if not have or (number is not None and number not in have):
        raise ValueError(f"{path} has no version {number if have else ''}".rstrip())
    return spark.read.parquet(_version_data(spark, path, number or max(have)))


def export_splits(splits: Mapping[str, DataFrame], path: str, meta: Mapping[str, Any] | None = None, dry_run: bool = False) -> dict:
    """Write each split under ``path`` with a manifest of columns, types and rows; a dry run only makes the manifest."""
    manifest = {"meta": dict(meta or {}), "splits": {k: {"columns": [list(x) for x in df.dtypes], "rows": df.count()} for k, df in splits.items()}}
    if not dry_run:
        for k, df in splits.items():
            write_parquet(df, f"{path}/{k}")
        spark = next(iter(splits.values())).sparkSession
        spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def import_splits(spark: SparkSession, path: str, wanted: Sequence[str]) -> dict[str, DataFrame]:
    """The wanted splits of an export. A missing split, column or row is an error; an extra split a warning."""
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    have = manifest["splits"]
    if missing := [k for k in wanted if k not in have]:
        raise ValueError(f"{path}: missing splits {missing}")
    if extra := [k for k in have if k not in wanted]:
        warnings.warn(f"{path}: splits that were not asked for: {extra}", stacklevel=2)
    out = {}
    for k in wanted:
        df = spark.read.parquet(f"{path}/{k}")
        if [list(x) for x in df.dtypes] != have[k]["columns"] or df.count() != have[k]["rows"]:
            raise ValueError(f"{path}/{k} is not what the manifest says")
        out[k] = df
    return out


def write_vectors(vectors: Mapping[str, DataFrame], path: str) -> None:
    """Each frame of ids and vec as a table ``path``/name, vectors in single precision."""
    for name, df in vectors.items():
        write_parquet(df.withColumn("vec", df["vec"].cast("array<float>")), f"{path}/{name}")


def read_vectors(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def verify_export(df: DataFrame, columns: Sequence[str], vector: str | None = None, dim: int | None = None) -> None:
    """Look at the first row: it must have the columns, and the vector its length."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    row = df.first()
    if row is None:
        raise ValueError("no rows")
    if vector and len(row[vector]) != dim:
        raise ValueError(f"{vector} has {len(row[vector])} dimensions, not {dim}")


def export_report(spark: SparkSession, path: str) -> DataFrame:
    """(split, problem, found): everything in which the splits under ``path`` differ from their manifest, over all rows.

    Problems are columns that are missing, extra or of another type, nulls by column, and
    another number of rows. Each split is read once.
    """
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    fixed, counts = [], []
    for name, want in manifest["splits"].items():
        df = spark.read.parquet(f"{path}/{name}")
        have, expected = dict(df.dtypes), dict(map(tuple, want["columns"]))
        fixed += [(name, f"missing column {c}", expected[c]) for c in expected if c not in have] + [(name, f"extra column {c}", have[c]) for c in have if c not in expected]
        fixed += [(name, f"type of {c}", have[c]) for c in expected if c in have and have[c] != expected[c]]
        found = [F.struct(F.lit(f"nulls in {c}").alias("problem"), F.count_if(F.col(c).isNull()).alias("n"), F.lit(0).cast("long").alias("want")) for c in df.columns]
        found.append(F.struct(F.lit("rows").alias("problem"), F.count(F.lit(1)).alias("n"), F.lit(want["rows"]).cast("long").alias("want")))
        counts.append(df.agg(F.array(*found).alias("x")).select(F.lit(name).alias("split"), F.explode("x").alias("x")))
    differ = [c.filter("x.n <> x.want").select("split", "x.problem", F.col("x.n").cast("string").alias("found")) for c in counts]
    return reduce(DataFrame.unionByName, differ, spark.createDataFrame(fixed, "split string, problem string, found string"))


def _plain(x: Any) -> Any:
    if isinstance(x, Path):
        return str(x)
    if isinstance(x, Mapping):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [_plain(v) for v in (sorted(x) if isinstance(x, (set, frozenset)) else x)]
    if hasattr(x, "tolist"):
        return _plain(x.tolist())
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(path: str | Path, value: Any) -> None:
    """Write JSON for numpy values and paths too, by rename."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, suffix=".tmp") as f:
        json.dump(_plain(value), f, indent=2)
    os.replace(f.name, path)


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text())


def update_section(path: str | Path, section: str, value: Any) -> None:
    """Replace one top-level key of a JSON file and keep the others."""
    whole = read_json(path) if Path(path).exists() else {}
    write_json(path, whole | {section: value})


def markdown(title: str, frames: Mapping[str, DataFrame], limit: int = 100) -> str:
    """A report: a table for each small frame, every number of it computed."""
    lines = [f"# {title}", ""]
    for name, df in frames.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(f"{v:.6g}" if isinstance(v, float) else str(v) for v in row) + " |" for row in df.limit(limit).collect()]
        lines.append("")
    return "\n".join(lines)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV part with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
