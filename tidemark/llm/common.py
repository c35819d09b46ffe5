"""Shared pieces of the training-data operators: the working folder and word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import Scratch, discard, hand_over, materialise, owning, release, shared_dir, stored

__all__ = ["SPACES", "WORD", "Scratch", "bind", "discard", "fold", "hand_over", "in_batches", "materialise", "owning", "release", "shared_dir", "stored", "table", "words_of"]

#: A word, everywhere in these operators: a run of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that WORD leaves out, as a literal string for translate().
SPACES = " \t\n\x0b\x0c\r"
#: Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def in_batches(df: DataFrame, rows: int = BATCH_ROWS, size: str = BATCH_BYTES) -> DataFrame:
    """``df``, with the session's Arrow batches set to at most so many rows and bytes.

    Texts are long: by default a task's Python worker would hold 10,000 of them at once. The
    setting is the session's and stays, as results are computed after this returns; larger
    batches asked for later hold for what is planned later.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def words_of(text: Column) -> Column:
    """array<string> of the words; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body (a lambda) uses it."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
