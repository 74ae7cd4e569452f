"""Splits and samples, by hashes instead of a shuffled list, so that they are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.staging import staged

#: Fixed values: (train, validation, test) shares of label files, by whether "book" is in the path.
BOOK, OTHER = (0.95, 0.025, 0.025), (0.90, 0.05, 0.05)


def hash_order(seed: int, key: Column) -> Column:
    """A text to order by: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def dealt(df: DataFrame, keys: list[str | Column], keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) dealt out by ranges of keys and sorted, with its partition (pid_) and place in it (at_), held fast."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staged(ranged.select(*(keep or ["*"]), F.spark_partition_id().alias("pid_"), (F.monotonically_increasing_id() % (1 << 33)).alias("at_")))


def numbered(df: DataFrame, order: list[str | Column], by: list[str] | None = None, out: str = "number", total: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df with each row's number, from 0, in order, within by; total: a further column with the rows of the row's group;
    keep: the columns that are wanted back, those of by among them.

    A global or a large group's order is not one sorted task: rows are dealt out by range, and the counts of the ranges
    before a row's own are added to its place.
    """
    by = by or []
    ranged = dealt(df, [*by, *order], keep)
    parts = ranged.groupBy("pid_", *by).agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = F.sum("n_").over(group.orderBy("pid_")) - F.col("n_")
    starts = parts.select(F.col("pid_").alias("p_"), *[F.col(c).alias(f"{c}_k") for c in by], (before - F.col("first_")).alias("shift_"), F.sum("n_").over(group).alias("total_"))
    same = F.col("pid_") == F.col("p_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_k"))
    extra = [F.col("total_").alias(total)] if total else []
    return ranged.join(staged(starts), same).select(*(keep or df.columns), (F.col("at_") + F.col("shift_")).alias(out), *extra)


def running_total(df: DataFrame, order: list[str], value: str, out: str = "total") -> DataFrame:
    """df with the sum of value over the rows before each row, in order, by the same dealing out."""
    ranged = dealt(df, order)
    here = F.sum(value).over(Window.partitionBy("pid_").orderBy("at_").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    parts = ranged.groupBy("pid_").agg(F.sum(value).alias("n_"))
    starts = parts.select(F.col("pid_").alias("p_"), (F.sum("n_").over(Window.orderBy("pid_")) - F.col("n_")).alias("start_"))
    return ranged.withColumn("here_", here).join(staged(starts), F.col("pid_") == F.col("p_")).select(*df.columns, (F.col("here_") + F.col("start_")).alias(out))


def split(df: DataFrame, group: str, key: str, seed: int = 42, out: str = "usage") -> DataFrame:
    """df with its usage: of each group's n rows in hash order the first int(n * v) are validation, the next int(n * t)
    test, the rest train."""
    counts = df.groupBy(F.col(group).alias("group_")).agg(F.count(F.lit(1)).alias("n_"))
    rows = numbered(df.withColumn("hash_", hash_order(seed, F.col(key))), ["hash_", key], [group], "number_")
    rows = rows.join(counts, F.col(group).eqNullSafe(F.col("group_")))
    book = F.coalesce(F.contains(F.col(group), F.lit("book")), F.lit(False))
    share = lambda k: F.when(book, F.floor(F.col("n_") * BOOK[k])).otherwise(F.floor(F.col("n_") * OTHER[k]))
    at = F.col("number_")
    return rows.select(*df.columns, F.when(at < share(1), "validation").when(at < share(1) + share(2), "test").otherwise("train").alias(out))


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (all if fewer), the first in hash order."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def topped_up(val: DataFrame, test: DataFrame, key: str, size: int = 300, seed: int = 42, leak_free: bool = False) -> tuple[DataFrame, DataFrame]:
    """(validation, test): a validation set above size is cut to it by key, a smaller one takes rows sampled from test.

    Those stay in the test set as well, unless leak_free.
    """
    n = val.count()
    if n > size:
        return val.orderBy(key).limit(size), test
    extra = sample(test, size - n, key, seed)
    rest = test.join(extra.select(key), key, "left_anti") if leak_free else test
    return val.unionByName(extra), rest


def buckets(df: DataFrame, order: str, size: int = 1000, out: str = "bucket") -> DataFrame:
    """df with the folder of its row: its number in order over size, as five digits."""
    return numbered(df, [order], out="number_").select(*df.columns, F.format_string("%05d", F.floor(F.col("number_") / size)).alias(out))
