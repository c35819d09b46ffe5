"""The training-corpus pipeline: language, near duplicates, benchmark leaks, mixing, token files.

run(spark, sf_dir) takes the table ``documents`` through STAGES. Each stage is a function of
(spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, language, mixing, token_file
from tidemark.llm.common import Scratch, discard, owning, shared_dir, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; those it rejects go. Where no language is labelled all with a letter stay."""
    return language.accepted(docs, language.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once, twice or not at all."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' own account of the documents in them, and the folder they are in.

    That is a new one inside ``tidemark.token_files`` if the session sets it, else in the shared folder.
    """
    base = spark.conf.get("tidemark.token_files", None)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}" if base else shared_dir(spark)
    return token_file.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), path).withColumn("path", F.lit(path))


STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("source_mix", source_mix), ("token_files", token_files),
]
#: Trained embeddings and token files are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with Scratch(spark) as tables, owning(tables):  # what a stage writes on its way goes with it
            docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
