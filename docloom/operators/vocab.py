"""Vocabularies: word, pair and token counts, byte-pair merges, unknown words and characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import characters, words
from . import bpe


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, freq) of what stands between white space. Counts combine before the shuffle."""
    return df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def symbols(counts: DataFrame) -> DataFrame:
    """(word, symbols, freq): words as characters and an end mark."""
    return counts.select("word", F.concat(characters(F.col("word")), F.array(F.lit(bpe.END))).alias("symbols"), "freq")


def pair_counts(vocab: DataFrame) -> DataFrame:
    """(left, right, freq) of neighbouring symbols."""
    s = F.col("symbols")
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return vocab.select(F.explode(pairs).alias("p"), "freq").groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("freq").alias("freq"))


def token_counts(vocab: DataFrame) -> DataFrame:
    """(token, freq) of symbols."""
    return vocab.select(F.explode("symbols").alias("token"), "freq").groupBy("token").agg(F.sum("freq").alias("freq"))


def merges(vocab: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """(merge_no, left, right, freq) of the first n merges (see bpe.learned)."""
    return bpe.learned(vocab, n, order)[0]


def trained_merges(vocab: DataFrame, n: int, order: str | None = None) -> list[tuple[str, str, int]]:
    """(left, right, freq) of each merge, in order."""
    return [(r["left"], r["right"], r["freq"]) for r in merges(vocab, n, order).orderBy("merge_no").collect()]


def most_frequent_pair(vocab: DataFrame) -> DataFrame:
    """The pair of the highest count, ties to the smaller pair; one row or none."""
    return pair_counts(vocab).orderBy(F.desc("freq"), "left", "right").limit(1)


def unknown_words(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, freq) of words that the vocabulary lacks."""
    return counts.join(vocab.select("word").distinct(), "word", "left_anti")


def unknown_characters(unknown: DataFrame, vocab: DataFrame) -> DataFrame:
    """(char, freq): distinct characters of unknown words that the vocabulary lacks, weighted by the words' counts."""
    chars = unknown.select(F.explode(F.array_distinct(characters(F.col("word")))).alias("char"), "freq")
    return chars.join(vocab.select(F.col("word").alias("char")).distinct(), "char", "left_anti").groupBy("char").agg(F.sum("freq").alias("freq"))


def renumbered_added(added: DataFrame, size: int, keep: int = 4) -> DataFrame:
    """(token, id, new_id) of added tokens: ids below keep stay, others follow from size - 1 in the order of their ids."""
    rest = F.row_number().over(Window.partitionBy(F.col("id") >= keep).orderBy("id")) - 1 + size - 1
    return added.select("token", "id", F.when(F.col("id") < keep, F.col("id")).otherwise(rest).cast("bigint").alias("new_id"))
