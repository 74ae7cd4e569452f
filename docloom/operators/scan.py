"""Segmented scans: running totals and neighbours within groups of any size, without a task for each group.

Rows are dealt out by ranges of group and order, so a group that holds most rows spans many partitions. Each partition
scans its own rows; what a group's earlier partitions come to is carried over, one row for each partition that a group
crosses. That works for every state that combines associatively: sums, counts, extremes, and what is made of them, such as
a streak that resets (rows so far less the rows up to the last reset, which is a maximum).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.staging import staged
from .splits import dealt


@dataclass(frozen=True)
class Total:
    """A running total: kind is sum, count, max or min; of the rows up to this one, or, if before, of those before it."""

    out: str
    kind: str
    value: Column
    before: bool = False


@dataclass(frozen=True)
class Neighbour:
    """The value of the row before (step -1) or after (step 1); null at the group's ends."""

    out: str
    value: Column
    step: int


_OF = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_JOIN = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "max": F.greatest, "min": F.least}


def ordered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df dealt out by ranges of by and order, with the columns pid_ and at_ that scans need; see closed."""
    return dealt(df, [*by, *order])


def closed(df: DataFrame) -> DataFrame:
    return df.drop("pid_", "at_")


def _part(x: Total | Neighbour) -> Column:
    """What a partition's rows of a group come to."""
    if isinstance(x, Total):
        return _OF[x.kind](x.value)
    edge = F.max_by if x.step < 0 else F.min_by
    return edge(F.struct(x.value.alias("v")), F.col("at_"))


def scanned(rows: DataFrame, by: list[str], wanted: list[Total | Neighbour]) -> DataFrame:
    """rows (of ordered) with the wanted columns. A scan may read the columns of scans before it."""
    parts = rows.groupBy("pid_", *by).agg(*[_part(x).alias(f"part_{k}") for k, x in enumerate(wanted)])
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)

    def carried(k: int, x: Total | Neighbour) -> Column:
        if isinstance(x, Total):
            return (F.sum if x.kind == "count" else _OF[x.kind])(f"part_{k}").over(earlier)
        return F.lag(f"part_{k}", -x.step).over(group.orderBy("pid_"))

    carries = parts.select(F.col("pid_").alias("p_"), *[F.col(c).alias(f"{c}_k") for c in by], F.count(F.lit(1)).over(group).alias("spans_"), *[carried(k, x).alias(f"carry_{k}") for k, x in enumerate(wanted)])
    carries = staged(carries.filter("spans_ > 1").drop("spans_"))
    same = F.col("pid_") == F.col("p_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_k"))
    own = Window.partitionBy("pid_", *by).orderBy("at_")

    def local(x: Total | Neighbour) -> Column:
        if isinstance(x, Total):
            return _OF[x.kind](x.value).over(own.rowsBetween(Window.unboundedPreceding, -1 if x.before else Window.currentRow))
        return F.lag(F.struct(x.value.alias("v")), -x.step).over(own)

    def whole(k: int, x: Total | Neighbour) -> Column:
        here, carry = F.col(f"here_{k}"), F.col(f"carry_{k}")
        if isinstance(x, Total):
            return F.coalesce(_JOIN[x.kind](here, carry), here, carry)
        return F.coalesce(here, carry)["v"]

    met = rows.withColumns({f"here_{k}": local(x) for k, x in enumerate(wanted)}).join(carries, same, "left")
    return met.select(*rows.columns, *[whole(k, x).alias(x.out) for k, x in enumerate(wanted)])
