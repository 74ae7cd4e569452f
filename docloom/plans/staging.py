"""Tables staged in the folder that driver and executors share, which cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .session import shared_dir

_own = threading.local()


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a staged table's folder."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone at exit; the folder is the cluster's to clean
        return


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage.

    Unlike a checkpoint of rows the copy is columnar, compressed and has statistics; it outlives lost executors.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"staged-{uuid.uuid4().hex}")
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    atexit.register(forget, spark, path)
    for held in _scopes():
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


class Log:
    """A staged table that grows: what is added stands in one folder, which is read as one table."""

    def __init__(self, spark: SparkSession, schema: StructType):
        self.spark, self.schema = spark, schema
        self.staged_path = os.path.join(shared_dir(spark), f"log-{uuid.uuid4().hex}")
        self.parts = 0
        atexit.register(forget, spark, self.staged_path)
        for held in _scopes():
            held.append(self.staged_path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.staged_path)
        self.parts += 1

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.staged_path)


def _scopes() -> list[list[str]]:
    """The open scopes of this thread, the paths staged in each."""
    if not hasattr(_own, "scopes"):
        _own.scopes = []
    return _own.scopes


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """A scope whose staged tables are deleted at its end, but for those given to what it yields."""
    held: list[str] = []
    kept: set[str] = set()
    _scopes().append(held)
    try:
        yield lambda *tables: kept.update(t.staged_path for t in tables)
    finally:
        _scopes().pop()
        for path in held:
            if path not in kept:
                forget(spark, path)


def distinct_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores added until df has no such column (names are compared without case)."""
    held = {c.lower() for c in df.columns}
    while wanted.lower() in held:
        wanted += "_"
    return wanted
