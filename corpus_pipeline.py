"""The corpus pipeline: documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.llm import line_dedup, mixing, packing, similar, toxicity
from docloom.llm.common import scratch, staged, table

#: Near duplicates: 5-word shingles shared by two texts over all of theirs, verified exactly after SimHash.
SHINGLE, SIMILARITY = 5, 0.8
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity grade is likelier to be above 0 go."""
    model = toxicity.fit(toxicity.keyed(docs), toxicity.graded(table(spark, sf_dir, "labels")))
    scored = toxicity.severity(docs, model)
    return scored.filter(~F.col(scored.columns[-1])).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that over a tenth of a source's documents share go; every document stays."""
    cleaned = line_dedup.drop_boilerplate(docs, F.col("source"))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of the smallest id, null ids last, then of the least text hash.

    A row is its id and text, so two texts under one id are two documents, and rows alike in both are one.
    """
    found = staged(similar.similar_groups(docs, shingle=SHINGLE, bound=SIMILARITY))
    text = F.col("text").cast("string")
    same = F.col("doc_id").eqNullSafe(F.col("id_of")) & F.when(text.isNotNull(), F.xxhash64(text)).eqNullSafe(F.col("print_of"))
    named = lambda rows: rows.select(F.col("id").alias("id_of"), F.col("print").alias("print_of"))
    left = docs.join(named(found.filter(~F.col("first"))), same, "left_anti")
    often = found.filter(F.col("first") & (F.col("copies") > 1))
    if often.isEmpty():
        return left
    return left.join(named(often), same, "left_anti").unionByName(left.join(named(often), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: by files, and in each file by rows."""
    placed = mixing.mixed(docs)
    position = placed.columns[-1]
    return placed.repartitionByRange(F.col(position)).sortWithinPartitions(position).select(docs.columns)


def file_order(docs: DataFrame) -> list[Column]:
    """The order of rows in the files that docs was read from, by the files' numbers; by id if it was not read from files."""
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-(\d{1,18})(?!\d)", 1).try_cast("bigint")  # beyond 99999 names don't sort by it
    order = [number, name, F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        return [F.col("doc_id")]
    return order


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, in the order of the mixture."""
    return packing.packed(docs, TOKENIZER, order_by=file_order(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Fitted models, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = staged(stage(spark, docs, sf_dir))
            keep(docs)
    return docs
