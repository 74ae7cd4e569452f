"""Row generators as table functions: training records of a partition as batches of tensors, in SQL or DataFrames.

    register(spark)
    SELECT * FROM batches(TABLE(rows) PARTITION BY source ORDER BY (id), 'text', 4)

The table function takes a partition in one task. Groups that hold a large share of a table go by ``batched``, which makes
the same batches with rows dealt out by range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .splits import numbered


@dataclass
class Asked(AnalyzeResult):
    """What a call asks for, worked out once from its arguments."""

    columns: tuple[str, ...] = ()
    size: int = 1


@udtf
class Batches:
    """Rows of a partition in batches: the number of a batch, its size, and an array of each column wanted.

    Arguments: the table, the names of the columns wanted (comma-separated; all if empty), and the rows of a batch. The
    result's columns follow from the table's. A batch is all that is held; the last one of a partition may be smaller.
    """

    def __init__(self, asked: Asked | None = None):
        self.asked, self.held, self.number = asked, [], 0

    @staticmethod
    def analyze(table: AnalyzeArgument, columns: AnalyzeArgument, size: AnalyzeArgument) -> Asked:
        if not table.isTable:
            raise ValueError("the first argument is a table")
        if size.value is None or size.value < 1:
            raise ValueError("a batch has one row at least")
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        wanted = tuple(c.strip() for c in columns.value.split(",")) if columns.value else tuple(kinds)
        if missing := [c for c in wanted if c not in kinds]:
            raise ValueError(f"no such column: {', '.join(missing)}")
        schema = StructType([StructField("batch", IntegerType()), StructField("n", IntegerType()), *[StructField(c, ArrayType(kinds[c])) for c in wanted]])
        return Asked(schema=schema, columns=wanted, size=int(size.value))

    def _out(self) -> tuple:
        batch, self.held = self.held, []
        self.number += 1
        return (self.number - 1, len(batch), *([r[c] for r in batch] for c in self.asked.columns))

    def eval(self, row: Row, columns: str, size: int) -> Iterator[tuple]:
        self.held.append(row)
        if len(self.held) == self.asked.size:
            yield self._out()

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield self._out()


def register(spark: SparkSession, name: str = "batches") -> None:
    spark.udtf.register(name, Batches)


def batched(rows: DataFrame, by: list[str], order: list[str | Column], columns: list[str], size: int) -> DataFrame:
    """by, batch, n and an array of each of the columns: the batches of each group in order, as the table function makes them.

    Rows are numbered over ranges of by and order, so a group of any size spans tasks; a task then gathers whole batches.
    """
    if size < 1:
        raise ValueError("a batch has one row at least")
    wanted = list(dict.fromkeys(columns))
    placed = numbered(rows, order, by, "number_", keep=list(dict.fromkeys([*by, *wanted])))
    at = F.col("number_")
    row = F.struct((at % size).cast("int").alias("at_"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(wanted)])
    held = placed.groupBy(*by, F.floor(at / size).alias("batch_")).agg(F.array_sort(F.collect_list(row)).alias("rows_"))
    arrays = [F.col("rows_")[f"c{k}"].alias(c) for k, c in enumerate(wanted) if c not in by]
    return held.select(*by, F.col("batch_").cast("bigint").alias("batch"), F.size("rows_").alias("n"), *arrays)
