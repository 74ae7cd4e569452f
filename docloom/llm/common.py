"""Helpers shared by the operators: tables, staged intermediates and checks of sizes."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.staging import distinct_name, scratch, staged

__all__ = ["distinct_name", "lean_worker", "scratch", "staged", "table"]


#: The option's number in glibc's malloc.h.
_M_MMAP_THRESHOLD = -3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean_worker() -> None:
    """Makes a Python worker give freed memory back at once; workers live on and share an executor's memory with its JVM.

    Arrow allocates by the C library, which maps every block of a megabyte or more on its own instead of keeping it.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(_M_MMAP_THRESHOLD, 1 << 20)
    except (AttributeError, OSError):  # not glibc: memory is kept a little longer
        return
