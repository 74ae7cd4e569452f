"""Substring dedup by hashing lines (or paragraphs) and the passages inside them.

Units are normalised (lower case, blanks collapsed) and hashed to 128 bits. The pieces of a text are the whole sentences
of its lines (or paragraphs). A unit is the fewest pieces from some piece on that have ``min_words`` words, across line
feeds too, or the fewest that end with a piece at which no such run ends. Units overlap, so every run of pieces of
``min_words`` words or more that two texts share is covered by units inside it, from its first piece to its last. A
character of a script without blanks counts as a word. All documents' digests are grouped globally; the earliest
occurrence by (document id, offset) stays and the others are removed from their documents.

Grouping combines before the shuffle, so a digest of any frequency is one row from each task; only digests that repeat
are kept. Occurrences meet them in a join of two staged tables, whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from .common import distinct_name, scratch, staged

#: A unit's least words. With 1 every repeated line or sentence goes, as short as it may be.
MIN_WORDS = 20
_SENTENCE = re.compile(r"[.!?]+[ \t]+(?=\S)|[。！？]+[ \t]*(?=\S)")
#: Characters that are words of their own: Han, kana, and the scripts of Thai, Lao, Burmese and Khmer.
_ALONE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")


def _blocks(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines or paragraphs that are not blank."""
    at = 0
    cuts = ((m.start(), m.end()) for m in _PARAGRAPH.finditer(text)) if unit == "paragraph" else ((m.start(), m.end()) for m in re.finditer("\n", text))
    for a, b in itertools.chain(cuts, [(len(text), len(text))]):
        if a > at and not text[at:a].isspace():
            yield at, a
        at = b


def units(text: str, unit: str = "line", min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit; offsets count code points of the text, end is past the last one."""
    alone = bool(_ALONE.search(text))
    if len(text) < (min_words if alone else 2 * min_words - 1):
        return
    pieces: list[tuple[int, int]] = []
    for start, end in _blocks(text, unit):
        pieces += itertools.pairwise([start, *(m.end() for m in _SENTENCE.finditer(text, start, end)), end])
    words = [text[a:b].lower().split() for a, b in pieces]
    sizes = [len(w) for w in words]
    if alone:
        sizes = [n + sum(len(_ALONE.findall(w)) - bool(_ALONE.match(w)) for w in own) for n, own in zip(sizes, words)]
    n, j, held, spans = len(sizes), 0, 0, []
    for i in range(n):
        while held < min_words and j < n:
            held += sizes[j]
            j += 1
        if held < min_words:
            break
        spans.append((i, j))
        held -= sizes[i]
    ends = {j for _, j in spans}
    i = held = 0
    for j in range(1, n + 1):
        held += sizes[j - 1]
        while held - sizes[i] >= min_words:
            held -= sizes[i]
            i += 1
        if held >= min_words and j not in ends:
            spans.append((i, j))
    if not spans:
        return
    # units overlap, so the normalised pieces lie in one buffer, a blank between two, and a unit is a stretch of it
    parts = [" ".join(w).encode("utf-8", "surrogatepass") for w in words]
    at = [0, *itertools.accumulate(len(p) + 1 if p else 0 for p in parts)]
    whole = memoryview(b" ".join(filter(None, parts)))
    for i, j in spans:
        yield pieces[i][0], pieces[j - 1][1], xxhash.xxh3_128_digest(whole[at[i] : at[j] - 1])


_UNITS = "start bigint, end bigint, d1 bigint, d2 bigint"


def _occurrences(keyed: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(no_id, id, print, start, end, d1, d2) of every unit."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, starts, ends, digests = [], [], [], []
            for k, text in enumerate(b.column(3)):
                for s, e, d in units(text.as_py() or "", unit, min_words):
                    row.append(k)
                    starts.append(s)
                    ends.append(e)
                    digests.append(d)
                if len(row) >= 200_000 or k == b.num_rows - 1:
                    two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in range(3)], pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1])], ["no_id", "id", "print", "start", "end", "d1", "d2"])
                    row, starts, ends, digests = [], [], [], []

    fields = [T.StructField("no_id", T.BooleanType()), T.StructField("id", keyed.schema["id"].dataType), T.StructField("print", T.LongType())]
    return keyed.mapInArrow(each, T.StructType([*fields, *T._parse_datatype_string(_UNITS).fields]))


def repeated_spans(keyed: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(no_id, id, print, spans): what units that occur earlier cover; keyed: no_id, id, print, text.

    Spans that touch or overlap are joined by windows over a document's sorted spans, in linear time.
    """
    found = staged(_occurrences(keyed, unit, min_words))
    rank = F.struct("no_id", "id", "print", "start")
    groups = found.groupBy("d1", "d2").agg(F.min(F.struct(rank.alias("rank"), F.col("end").alias("end"))).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = staged(groups.select(F.col("d1").alias("g1"), F.col("d2").alias("g2"), "first"))
    met = found.join(groups, (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2"))).filter(rank > F.col("first.rank"))
    same = F.struct("no_id", "id", "print").eqNullSafe(F.struct("first.rank.no_id", "first.rank.id", "first.rank.print"))
    begin = F.when(same, F.greatest("start", "first.end")).otherwise(F.col("start"))
    document = ["no_id", "id", "print"]
    spans = met.select(*document, begin.alias("start"), "end").filter("start < end")
    by = Window.partitionBy(*document).orderBy("start", "end")
    apart = F.col("start") > F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    island = F.sum(F.col("apart").cast("bigint")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = spans.withColumn("apart", apart).withColumn("island", island).groupBy(*document, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy(*document).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


@pandas_udf(T.StringType())
def _kept(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else "".join(t[a:b] for a, b in zip([0, *e], [*s, len(t)])) for t, s, e in zip(text, begins, ends)], dtype=object)


def kept(text: Column, spans: Column) -> Column:
    """What is left of text outside the spans; null without spans, whose texts don't leave the JVM."""
    part = lambda end: F.transform(spans, lambda s: s[end])
    return _kept(F.when(spans.isNotNull(), text), part("start"), part("end"))


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS, spans_col: str = "removed_spans") -> DataFrame:
    """df with later occurrences of repeated units cut out of text_col, and their spans in spans_col.

    Spans are (start, end) in code points of the original text, sorted and disjoint; a document without any has an
    empty array. Ids rank documents, null ids last, then a hash of the text. Rows alike in id and text are one document
    and get the same result. A unit that repeats inside a document stays once; if its copies overlap the first one
    stays whole. Null texts stay null. Texts of fewer than min_words words never change. Every row and other column
    stays, whatever its name; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    out = distinct_name(df, spans_col)
    names = {c: distinct_name(df, f"key_{c}") for c in ("no_id", "id", "print")}
    key = {"no_id": F.col(id_col).isNull(), "id": F.col(id_col), "print": F.xxhash64(text)}
    with scratch(df.sparkSession) as keep:
        spans = repeated_spans(df.select(*[v.alias(k) for k, v in key.items()], text.alias("text")), unit, min_words)
        spans = staged(spans.select(*[F.col(k).alias(f"{v}_") for k, v in names.items()], F.col("spans").alias("found_spans")))
        keep(spans)
    met = df.withColumns({names[k]: v for k, v in key.items()})
    met = met.join(spans, (met[names["no_id"]] == spans[f"{names['no_id']}_"]) & met[names["id"]].eqNullSafe(spans[f"{names['id']}_"]) & (met[names["print"]] == spans[f"{names['print']}_"]), "left")
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    cut = F.coalesce(kept(text, F.col("found_spans")), text)
    return met.select(*[cut.alias(c) if c == text_col else met[c] for c in df.columns], F.coalesce("found_spans", none).alias(out))
