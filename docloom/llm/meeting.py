"""Links inside groups of any size.

A task compares all rows of a small group, or of two chunks of a larger one. Up to ``CHUNKS`` chunks are met in all pairs,
which moves a row as often at most. Components are all that is asked for, so beyond that a group is met in steps:

1. Each chunk is compared within itself. Rows that hang together get one label.
2. One row of each label meets those of the others, in pairs of chunks.
3. Where labels are left apart, the rows outside the group's largest label meet all others, in pairs of chunks.

A large group of near copies hangs together after two steps, and each of its rows has moved once; what grows with the
square of a group are the rows that its links leave apart. No pair of rows under different labels is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import scratch, staged

#: Chunks of a group that are met in all pairs at once.
CHUNKS = 8
Finder = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _upto(n: Column, f: Callable[[Column], Column]) -> Column:
    """f of each number below n, which is 1 at least."""
    return F.transform(F.sequence(_long(0), n - 1), f)


def _chunks(n: Column, load: Column, rows: int, most: int) -> Column:
    return F.ceil(F.greatest(n / rows, load / most)).cast("bigint")


def _pair(i: Column, j: Column, m: Column) -> Column:
    """A number for the chunks i and j of m, in either order."""
    return F.least(i, j) * m + F.greatest(i, j)


def dealt(rows: DataFrame, by: list[str], node: str, rest: list[str], parts: Column, find: Finder) -> DataFrame:
    """Edges (a, b) that find gives for the rows of each part of a group."""
    each = rows.select(*by, F.explode(parts).alias("part"), node, *rest)
    return each.repartition(*by, "part").sortWithinPartitions(*by, "part", node).mapInArrow(find, "a binary, b binary")


def spanning(rows: DataFrame, by: list[str], node: str, load: Column, chunk_rows: int, chunk_load: int, find: Finder, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) of nodes that span every component of the links inside the groups of rows.

    rows: by, node and what find reads besides, distinct in by and node; staged, as they are read several times. find
    takes partitions sorted by group and part and gives a spanning forest of the links of each part. load: what a row
    weighs against chunk_load. components: (node, root) of edges.
    """
    rest = [c for c in rows.columns if c not in (*by, node)]
    with scratch(rows.sparkSession) as keep:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(load).alias("load"))
        several = staged(sizes.select(*by, _chunks(F.col("n"), F.col("load"), chunk_rows, chunk_load).alias("m"), "n").filter("m > 1"))
        chunk = F.pmod(F.xxhash64(node), F.col("m"))
        pairs = _upto(F.col("m"), lambda j: _pair(chunk, j, F.col("m")))
        parts = F.when(F.col("m").isNull(), F.array(_long(0))).when(F.col("m") <= CHUNKS, pairs).otherwise(F.array(chunk))
        if several.isEmpty():
            first = staged(dealt(rows, by, node, rest, F.array(_long(0)), find).distinct())
        else:
            first = staged(dealt(rows.join(several, by, "left"), by, node, rest, parts, find).distinct())
        heavy = several.filter(F.col("m") > CHUNKS)
        if heavy.isEmpty():
            keep(first)
            return first

        def labelled(edges: DataFrame) -> DataFrame:
            """Rows of large groups with their label."""
            of = components(edges).select(F.col("node").alias("node_"), F.col("root").alias("root_"))
            own = rows.join(heavy.select(*by, "n"), by).withColumn("load_", load)
            return staged(own.join(of, F.col(node) == F.col("node_"), "left").select(*by, "n", node, *rest, "load_", F.coalesce("root_", node).alias("label")))

        large = labelled(first)
        one = large.groupBy(*by, "label").agg(F.min(node).alias(node))
        told = staged(large.join(one.select(*by, node), [*by, node]).select(*by, node, *rest, "load_"))
        m = told.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"), _chunks(F.count(F.lit(1)), F.sum("load_"), chunk_rows, chunk_load).alias("m"))
        counts = staged(m)
        second = staged(dealt(told.join(counts, by), by, node, rest, pairs, find).distinct())

        large = labelled(first.union(second))
        labels = large.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("load_").alias("load"), F.max("n").alias("n"))
        main = labels.groupBy(*by).agg(F.max(F.struct("rows", "label")).alias("main"), F.count(F.lit(1)).alias("left"), F.sum("rows").alias("rows"), F.sum("load").alias("load"), F.max("n").alias("n"))
        main = main.join(counts.select(*by, "labels"), by).filter((F.col("left") > 1) & (F.col("labels") < F.col("n")))
        of_main = labels.select(*by, F.col("label").alias("main_label"), F.col("load").alias("main_load"))
        main = main.join(of_main, by).filter(F.col("main_label") == F.col("main.label"))
        apart = _chunks(F.col("rows") - F.col("main.rows"), F.col("load") - F.col("main_load"), chunk_rows, chunk_load)
        main = staged(main.select(*by, "main_label", _chunks(F.col("main.rows"), F.col("main_load"), chunk_rows, chunk_load).alias("m"), apart.alias("others")))
        third = staged(dealt(large.join(main, by), by, node, rest, _meetings(node), find).distinct())
        found = staged(first.union(second).union(third).distinct())
        keep(found)
    return found


def _meetings(node: str) -> Column:
    """The parts of a row: m chunks of the main label meet each chunk of the others, and those each other."""
    m, others, h = F.col("m"), F.col("others"), F.xxhash64(node)
    i, j = F.pmod(h, m), F.pmod(h, others)
    main = _upto(others, lambda k: i * others + k)
    other = F.concat(_upto(m, lambda k: k * others + j), _upto(others, lambda k: m * others + _pair(j, k, others)))
    return F.when(F.col("label") == F.col("main_label"), main).otherwise(other)
