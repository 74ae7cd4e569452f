"""Line dedup by site-relative frequency, in DataFrame expressions only.

A line is boilerplate of a host if over ``ratio`` of the host's pages contain it and it is shared at all, that is on
``min_pages`` pages: without that a host of one page, all of whose lines are on every page, would lose its text. Lines
are compared by a digest after trimming blanks. Counts combine before their shuffle, so a line or host of any frequency
is no hot task; only digests move. A host has at most (mean lines of its pages) / ratio such lines, so they fit in one
row for each host; documents meet that row by host, broadcast where Spark finds the staged table small, else by a
sort-merge join whose skewed partitions adaptive execution splits (each document needs its host's row only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import distinct_name, scratch, staged

RATIO, MIN_PAGES = 0.1, 2


def host_of(url: Column) -> Column:
    """The host of a URL, lower-case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


_EMPTY = "xxhash64('')"


def boilerplate(df: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """(host, digests): the digests of each host's boilerplate lines."""
    pages = df.select(host.alias("host"), text.alias("text")).filter(F.col("host").isNotNull())
    seen = pages.select("host", F.explode(F.array_remove(F.array_distinct(F.transform(_lines(F.col("text")), _digest)), F.expr(_EMPTY))).alias("digest"))
    often = staged(seen.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages))
    totals = staged(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    return often.join(totals, "host").filter(F.col("n").cast("double") / F.col("pages") > ratio).groupBy("host").agg(F.collect_set("digest").alias("digests"))


def drop_boilerplate(df: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, dropped_col: str = "dropped_lines") -> DataFrame:
    """df with boilerplate lines taken out of text_col, and the number taken out in dropped_col (a further name if taken).

    Every row stays: a text of boilerplate only becomes empty, null texts stay null and drop 0 lines, and rows of a null
    host are not a site and stay as they are. All rows of a host count as its pages, also empty, null and repeated
    ones. Empty lines are never boilerplate. Line feeds part lines; the other columns pass through, whatever their names.
    """
    with scratch(df.sparkSession) as keep:
        found = staged(boilerplate(df, host, F.col(text_col).cast("string"), ratio, min_pages))
        keep(found)
    key, bad, out = (distinct_name(df, c) for c in ("host_key", "host_digests", dropped_col))
    text = F.col(text_col).cast("string")
    met = df.withColumn(key, host).join(found.select(F.col("host").alias(f"{key}_"), F.col("digests").alias(bad)), F.col(key) == F.col(f"{key}_"), "left")
    kept = F.filter(_lines(text), lambda line: ~F.array_contains(F.col(bad), _digest(line)))
    cleaned = F.when(F.col(bad).isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col(bad).isNull() | text.isNull(), F.lit(0)).otherwise(F.size(_lines(text)) - F.size(kept))
    return met.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns], dropped.cast("int").alias(out))
