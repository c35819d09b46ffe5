"""The working folder that all executors share, and tables written to it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions without the setting, by application.
_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name inside ``spark.checkpoint.dir``, which all executors can reach.

    Only where that setting is absent and the master is local (tests, a laptop) a temporary
    folder is made; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _temporary.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = _temporary[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> tuple[DataFrame, str]:
    """``df`` written to a new shared folder and read back, with the folder."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that stored() wrote and nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables that are needed for a while: ``with Scratch(spark) as tables`` deletes those of store() at the end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def store(self, df: DataFrame) -> DataFrame:
        """As materialise(), until the end of the block."""
        out, path = stored(df)
        self.paths.append(path)
        return out

    def close(self) -> None:
        """Delete the tables; frames made of them can't be read any more."""
        while self.paths:
            discard(self.spark, self.paths.pop())


#: Whose the tables are that materialise() writes: the block's of owning(), else the thread's.
_owner: ContextVar[Scratch | None] = ContextVar("owner", default=None)
_thread = threading.local()


@contextmanager
def owning(tables: Scratch) -> Iterator[Scratch]:
    """What materialise() writes within the block, in this thread, belongs to ``tables``, which decides how long it stays."""
    before = _owner.set(tables)
    try:
        yield tables
    finally:
        _owner.reset(before)


def _owning(spark: SparkSession) -> Scratch:
    owner = _owner.get()
    return owner if owner is not None else _thread.__dict__.setdefault("tables", Scratch(spark))


def hand_over(spark: SparkSession, path: str) -> None:
    """A folder that stored() wrote now belongs to whom materialise() would write for."""
    _owning(spark).paths.append(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage for good.

    As what is made of the table is computed later, it stays: until its owner, see owning(), is
    closed, or without one until the same thread calls release().
    """
    return _owning(df.sparkSession).store(df)


def release(spark: SparkSession) -> None:
    """Delete what materialise() wrote in this thread for no owner; frames made of it can't be read any more."""
    _thread.__dict__.pop("tables", Scratch(spark)).close()
