"""What must not grow in one task or faster than its input."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import codec
from docloom.operators import bpe, field_metric, generators, vocab
from docloom.plans import record_queries, registry  # noqa: F401


@pytest.fixture
def apart(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_line_batches_of_one_flag_span_tasks(spark, sf, tmp_path, apart):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_returnflag", F.lit("N"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = registry.QUERIES["line_batches"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows}) > 1
    assert sum(r["n"] for r in rows) == lines.count() and [r["n"] for r in rows if r["n"] != 64] == [lines.count() % 64]


def test_batched_makes_the_batches_of_the_table_function(spark, apart):
    rows = spark.range(500).select(F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("g"), (F.col("id") * 37 % 500).alias("k"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id"))).alias("t"))
    generators.register(spark)
    rows.createOrReplaceTempView("grouped")
    held = lambda df: sorted((r["g"] is not None, r["g"] or 0, r["batch"], r["n"], r["k"], r["t"]) for r in df.collect())
    expected = spark.sql("SELECT g[0] AS g, batch, n, k, t FROM batches(TABLE(grouped) PARTITION BY g ORDER BY (k), 'g, k, t', 8)")
    assert held(generators.batched(rows, ["g"], ["k"], ["k", "t"], 8)) == held(expected)
    with pytest.raises(ValueError, match="one row at least"):
        generators.batched(rows, ["g"], ["k"], ["k"], 0)


def test_merges_stage_chunks_and_not_words_again(spark, sf, monkeypatch):
    """A pass leaves its best pairs alone; what is staged besides are some thousands of words to a row."""
    words = vocab.symbols(vocab.word_counts(spark.read.parquet(f"{sf}/documents.parquet"), "text")).cache()
    rows, own, add = {}, bpe.staged, bpe.Log.add

    def staged(df, *rest):
        out = own(df, *rest)
        rows[out.staged_path] = out.count()
        return out

    def added(self, df):
        add(self, df)
        rows[self.staged_path] = self.read().count()

    monkeypatch.setattr(bpe, "staged", staged)
    monkeypatch.setattr(bpe.Log, "add", added)
    monkeypatch.setattr(bpe, "PASSES", 2)
    found, took = bpe.learned(words, 6)
    assert found.count() == 6 and sum(rows.values()) <= 100 + bpe.TOP * took["passes"] < words.count()


@pytest.mark.parametrize("dense", [0, 1 << 11])
def test_chunks_of_codes_merge_and_count_as_words_do(monkeypatch, dense):
    monkeypatch.setattr(bpe, "_DENSE", dense)
    words, freq = [[*"aaab"], [], [*"abab"], ["é", "a", "a"]], np.array([2, 5, 3, 1])
    names, codes = bpe._coded(pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string()))], ["symbols"]))
    names, codes = bpe._after(names, codes, [("a", "a"), ("a", "b"), ("x", "a"), ("aa", "ab")])
    assert [names[k] if k >= 0 else "|" for k in codes] == ["aaab", "|", "|", "ab", "ab", "|", "é", "aa", "|"]
    _, keys, word = bpe._pairs(names, codes)
    found, total = bpe._sums(keys, freq[word], len(names))
    assert {(names[k // len(names)], names[k % len(names)]): n for k, n in zip(found.tolist(), total.tolist())} == {("ab", "ab"): 3, ("é", "aa"): 1}


def test_field_f1_deals_lines_out_once(spark, sf):
    """Documents and predictions come from one grouping."""
    plan = registry.QUERIES["field_f1"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") > 0 and plan.count("collect_list(") == 1


def test_line_tokens_are_parsed_as_columns(spark, sf):
    """No lambda is interpreted for each part of a line; a line with many keys, two of them equal, is not searched for each key."""
    plan = registry.QUERIES["json_decode_v2"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "map_from_entries" not in plan
    rnd = random.Random(7)
    texts = ["\t".join(f"k{k % 49_999}:{k}" for k in range(50_000)), None, ""]
    texts += ["".join(rnd.choice("aaabé: \t\n\r:\n") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for text, found in zip(texts, codec.parsed(pa.array(texts, pa.string())).to_pylist()):
        told = codec.unlined(text) if text is not None else {}
        groups = [list(g.items()) for g in told.pop("groups", [])]
        assert found == ({"fields": list(told.items()), "groups": groups} if text is not None else {"fields": None, "groups": None})
    part = pa.array(["x", "a:1\tb:2", None, "c:3"])[1:]
    assert codec.parsed(part).to_pylist() == [{"fields": [], "groups": [[("a", "1"), ("b", "2")]]}, {"fields": None, "groups": None}, {"fields": [("c", "3")], "groups": []}]


def test_few_texts_find_the_last_of_the_most_alike():
    rnd = random.Random(5)
    for _ in range(500):
        texts = ["".join(rnd.choice("ab-é") for _ in range(rnd.randint(0, 5))) for _ in range(rnd.randint(0, 8))]
        free = bytearray(rnd.randint(0, 1) for _ in texts)
        own = "".join(rnd.choice("abc-") for _ in range(rnd.randint(0, 5)))
        expected = max((k for k in range(len(texts)) if free[k]), key=lambda k: (field_metric.likeness(own, texts[k]), k), default=None)
        assert field_metric._Few(texts).best(own, free) == expected == (field_metric._Ordered(texts).best(own, free) if texts else None)
