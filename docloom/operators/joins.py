"""Joins of records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .splits import running_total


def paired(pred: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """Predictions and truths of equal sample ids; a sample that one side lacks raises an error when it is read."""
    met = pred.withColumn("left_", F.lit(True)).join(gold.withColumn("right_", F.lit(True)), by, "full_outer")
    both = F.col("left_").isNotNull() & F.col("right_").isNotNull()
    lone = F.raise_error(F.concat(F.lit("a sample without its counterpart: "), F.coalesce(F.col(by).cast("string"), F.lit("null")))).cast("boolean")
    return met.filter(F.when(both, F.lit(True)).otherwise(lone)).drop("left_", "right_")


def remaining(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows not among those done already; repeated rows stay."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def field_union(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Fields of either side: (by, pred_value, gold_value)."""
    return pred.join(gold, by, "full_outer")


def looked_up(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """df with the columns of a lookup table; Spark broadcasts it if it is small."""
    return df.join(table, on, how)


def vocabulary_map(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, old_id) by token, of (token, id) tables; a token that the old one lacks raises an error."""
    met = new.join(old.select(F.col("token").alias("old_token"), F.col("id").alias("old_id")), F.col("token") == F.col("old_token"), "left")
    checked = F.when(F.col("old_id").isNull(), F.raise_error(F.concat(F.lit("not in the old vocabulary: "), F.col("token"))).cast("bigint")).otherwise(F.col("old_id"))
    return met.select(F.col("id").alias("new_id"), checked.alias("old_id"))


def gathered(ids: DataFrame, vectors: DataFrame, id_col: str) -> DataFrame:
    """Vectors under new ids: the row of each (new_id, old_id)."""
    return ids.join(vectors, ids["old_id"] == vectors[id_col]).select("new_id", *[c for c in vectors.columns if c != id_col])


def pruned_weights(new: DataFrame, old: DataFrame, tables: dict[str, DataFrame], id_col: str, update=None) -> dict[str, DataFrame]:
    """Weight tables (embedding, output head) of a model under a smaller vocabulary.

    new, old: (token, id). update(ids, tables) is the model's own rule, with ids as (new_id, old_id); without one every
    table is gathered, as models without tied weights need it.
    """
    ids = vocabulary_map(new, old)
    if update is not None:
        return update(ids, tables)
    return {name: gathered(ids, table, id_col) for name, table in tables.items()}


def tied(ids: DataFrame, tables: dict[str, DataFrame], source: str = "embedding", id_col: str = "id") -> dict[str, DataFrame]:
    """The update rule of a model whose tables are all the embedding."""
    one = gathered(ids, tables[source], id_col)
    return dict.fromkeys(tables, one)


def sibling(path: Column, folder: str, to: str, suffix: str) -> Column:
    """The path of the file of the same name in a sibling folder, with another suffix."""
    return F.concat(F.regexp_replace(F.replace(path, F.lit(f"/{folder}/"), F.lit(f"/{to}/")), r"\.[^./]*$", ""), F.lit(suffix))


def placeholders_filled(prompts: DataFrame, grids: DataFrame, by: str, text: str, order: str, ordinal: str, fill: Column, mark: str = "<|image_pad|>") -> DataFrame:
    """The n-th mark over all prompts in order takes the n-th grid's text, ordinals from 0; surplus marks stay.

    Counts of marks before each prompt come from a running sum over (prompt, count) rows; texts are not sorted.
    """
    parts = F.split(F.col(text), mark.replace("|", r"\|"))
    counted = prompts.select(by, *({order} - {by}), (F.size(parts) - 1).alias("marks"))
    starts = running_total(counted, [order, by], "marks", "start").select(by, "start")
    pieces = prompts.join(starts, by).select(by, "start", F.posexplode(parts).alias("at", "piece"))
    filled = grids.select(F.col(ordinal).cast("bigint").alias("ordinal_"), fill.alias("fill_"))
    met = pieces.join(filled, (F.col("at") > 0) & (F.col("start") + F.col("at") - 1 == F.col("ordinal_")), "left")
    said = F.concat(F.when(F.col("at") > 0, F.coalesce("fill_", F.lit(mark))).otherwise(F.lit("")), F.col("piece"))
    return met.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", said.alias("said")))).alias("all_")).select(by, F.array_join(F.transform("all_", lambda x: x["said"]), "").alias("filled"))


#: Boxes of a strip, about; and boxes and pairs that are swept together.
STRIP, SWEPT, TRIED = 4096, 1 << 16, 1 << 20


def _sweep(group: np.ndarray, first: np.ndarray, box: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the boxes of a group that meet, rows sorted by group and x1; box: x1, y1, x2, y2.

    A line moves along x: a box meets those that begin before it ends, which stand next to it in that order. Of them the
    ones whose y ranges meet are kept, in the strip that first holds both. first: the strip that a box begins in.
    """
    n = len(group)
    values, rank = np.unique(np.concatenate((box[:, 0], box[:, 2])), return_inverse=True)
    start, end = group * len(values) + rank[:n], group * len(values) + rank[n:]
    todo = np.searchsorted(start, end, side="right") - np.arange(n) - 1
    total, at = np.cumsum(todo), 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TRIED, side="right")))
        i = np.repeat(np.arange(at, upto), todo[at:upto])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(todo[at:upto]) - todo[at:upto], todo[at:upto])
        meet = (box[i, 1] <= box[j, 3]) & (box[j, 1] <= box[i, 3]) & (first[i] | first[j])
        if meet.any():
            yield i[meet], j[meet]
        at = upto


def overlapping(boxes: DataFrame, by: str, key: str) -> DataFrame:
    """(by, left_key, right_key) of boxes x1, y1, x2, y2 of one page that meet or touch, left_key < right_key.

    A plane sweep over each page; a page of more than STRIP boxes is parted by height into strips, each a task's work of
    its own, and a box stands in all strips that it reaches. A pair counts in the strip that holds the upper edge of its
    common part. Boxes with nulls, and boxes whose x2 or y2 lies before x1 or y1, meet nothing.
    """
    edges = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    rows = boxes.select(by, key, *edges).filter("x1 <= x2 AND y1 <= y2")
    pages = rows.groupBy(by).agg(F.min("y1").alias("top_"), F.max("y1").alias("low_"), F.ceil(F.count(F.lit(1)) / STRIP).alias("strips_"))
    met = rows.join(pages.withColumnRenamed(by, "page_"), F.col(by).eqNullSafe(F.col("page_")))
    strip = lambda y: F.when(F.col("low_") > F.col("top_"), F.least(F.col("strips_") - 1, F.floor((y - F.col("top_")) / (F.col("low_") - F.col("top_")) * F.col("strips_")))).otherwise(F.lit(0)).cast("int")
    met = met.withColumn("from_", strip(F.col("y1"))).withColumn("strip_", F.explode(F.sequence("from_", strip(F.least("y2", "low_")))))
    met = met.withColumn("first_", F.col("from_") == F.col("strip_")).select(by, key, "strip_", "first_", "x1", "y1", "x2", "y2")
    dealt = met.repartition(by, "strip_").sortWithinPartitions(by, "strip_", "x1")
    schema = T.StructType([dealt.schema[by], T.StructField("a", dealt.schema[key].dataType), T.StructField("b", dealt.schema[key].dataType)])

    def swept(t: pa.Table) -> Iterator[pa.RecordBatch]:
        page, strips = t[by].combine_chunks().dictionary_encode("encode").indices.to_numpy(), t["strip_"].to_numpy()
        group = np.concatenate(([0], np.cumsum((page[1:] != page[:-1]) | (strips[1:] != strips[:-1]))))
        box = np.stack([t[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], 1)
        pages, keys = t[by].combine_chunks(), t[key].combine_chunks()
        for i, j in _sweep(group, t["first_"].to_numpy(), box):
            i, j = pa.array(i), pa.array(j)
            yield pa.RecordBatch.from_arrays([pages.take(i), keys.take(i), keys.take(j)], [by, "a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = pa.concat_tables([rest, t]) if rest is not None else t
            if rest.num_rows < SWEPT:
                continue
            last = [rest[c][-1].as_py() for c in (by, "strip_")]
            cut = rest.num_rows
            while cut and [rest[c][cut - 1].as_py() for c in (by, "strip_")] == last:
                cut -= 1
            if cut:
                yield from swept(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield from swept(rest)

    found = dealt.mapInArrow(each, schema).filter("a <> b")
    return found.select(by, F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key"))
