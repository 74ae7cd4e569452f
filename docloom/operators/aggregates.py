"""Aggregates over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import scan

#: Upper bounds of the length bins.
BINS = (1000, 2560)


def recognition_score(scores: Column) -> Column:
    """Mean of an array of scores, its count smoothed."""
    return F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x) / (F.size(scores) + 0.0005)


def length_bins(df: DataFrame, text: str) -> DataFrame:
    """(bin, n) of text lengths; nulls are left out."""
    n = F.char_length(text)
    named = F.when(n < BINS[0], F.lit(f"<{BINS[0]}")).when(n < BINS[1], F.lit(f"{BINS[0]}<=x<{BINS[1]}")).otherwise(F.lit(f">={BINS[1]}"))
    return df.filter(F.col(text).isNotNull()).groupBy(named.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def counted(df: DataFrame, by: str) -> DataFrame:
    """(by, n), most first."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def members(df: DataFrame, by: str, member: str) -> DataFrame:
    """(by, n, members) with members sorted, most first. For groups whose members are few enough to list."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(member)).alias("members")).orderBy(F.desc("n"), by)


def with_total(df: DataFrame, by: str, value: str, count: str | None = None) -> DataFrame:
    """(by, mean, n) for each group and over all (by null, is_total)."""
    n = F.count(value) if count is None else F.sum(count)
    return df.groupingSets([[by], []], by).agg((F.sum(value) / n).alias("mean"), n.alias("n"), (F.grouping(by) == 1).alias("is_total")).filter(~F.col("is_total") | (F.col("n") > 0))


def running_mean(df: DataFrame, value: str, by: str, order: list[str], out: str = "mean_loss") -> DataFrame:
    """Running sum over a smoothed running count, in order within each by; groups may be of any size."""
    rows = scan.scanned(scan.ordered(df, [by], order), [by], [scan.Total("sum_", "sum", F.col(value)), scan.Total("n_", "count", F.lit(1))])
    return scan.closed(rows.withColumn(out, F.col("sum_") / (F.col("n_") + 0.001)).drop("sum_", "n_"))


def correction_scores(df: DataFrame, errors: Column, length: Column) -> DataFrame:
    """(sentence_score, char_score, score): shares without errors, counts smoothed, and their mean."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(errors > 0).alias("bad"), F.sum(errors).alias("errors"), F.sum(length).alias("chars"))
    sentence, char = 1 - F.col("bad") / (F.col("n") + 0.001), 1 - F.col("errors") / (F.col("chars") + 0.001)
    return sums.select(sentence.alias("sentence_score"), char.alias("char_score"), ((sentence + char) / 2).alias("score"))


def size_ratio(part: Column, whole: Column, places: int = 4) -> Column:
    return F.round(F.try_divide(part, whole), places)


def best_so_far(df: DataFrame, value: str, by: str, order: list[str], patience: int = 3) -> DataFrame:
    """Each step with the best before it, whether it is better, its streak of steps that are not, and stopped: whether a
    streak has reached patience by then. Groups may be of any size; a null is no improvement."""
    best, n = F.col("best_before"), F.col("n_")
    rows = scan.scanned(scan.ordered(df, [by], order), [by], [scan.Total("best_before", "max", F.col(value), before=True), scan.Total("n_", "count", F.lit(1))])
    rows = rows.withColumn("improved", best.isNull() | F.coalesce(F.col(value) > best, F.lit(False)))
    rows = scan.scanned(rows, [by], [scan.Total("reset_", "max", F.when(F.col("improved"), n))])
    rows = rows.withColumn("streak", (n - F.col("reset_")).cast("int")).withColumn("late_", (F.col("streak") >= patience).cast("int"))
    rows = scan.scanned(rows, [by], [scan.Total("stop_", "max", F.col("late_"))])
    return scan.closed(rows.withColumn("stopped", F.col("stop_") == 1).drop("n_", "reset_", "late_", "stop_"))
