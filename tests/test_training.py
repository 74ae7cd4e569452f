"""Training batches."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import training


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_targets_and_tokens(spark):
    df = spark.createDataFrame([('{"b": ["x", "y"], "a": "1"}',)], "ground_truth string")
    r = training.preprocessed(df, tokenizer(), length=64, pad=0).collect()[0]
    assert r["target"] == "<s_a>1</s_a><s_b>x<sep/>y</s_b></s>" and len(r["labels"]) == 64 and r["labels"][-1] == 0
    back = df.select(training.decoded(training.encoded(F.lit("Hello, tokens!"), tokenizer()), tokenizer()).alias("t")).collect()
    assert back[0]["t"] == "Hello, tokens!"


def test_tensors_round_trip(spark):
    df = spark.createDataFrame([([1, 2, 2], [0.5, 1.0, -1.0, 2.0]), (None, None)], "shape array<int>, v array<float>")
    rows = df.select(training.packed_tensor("shape", "v").alias("b")).select("b", training.unpacked_tensor("b").alias("t")).collect()
    assert len(rows[0]["b"]) == 12 + 16 and rows[0]["t"]["shape"] == [1, 2, 2] and rows[0]["t"]["values"] == [0.5, 1.0, -1.0, 2.0]
    assert rows[1]["b"] is None


def test_rotation_and_batches(spark):
    df = spark.createDataFrame([(1, 0, [1]), (2, 90, [1, 2, 3]), (3, 10, [4]), (4, None, [5, 6])], "k int, angle int, ids array<int>")
    assert [r["a"] for r in df.orderBy("k").select(training.rotation(F.col("angle")).alias("a")).collect()] == [None, 270, 350, None]
    out = training.collated(df, "k", "ids", 2, 0).orderBy("k").collect()
    assert [r["input_ids"] for r in out] == [[0, 0, 1], [1, 2, 3], [0, 4], [5, 6]] and out[0]["attention_mask"] == [0, 0, 1] and [r["batch"] for r in out] == [0, 0, 1, 1]
    flags = df.withColumn("b", F.col("k") % 2).withColumn("u", training.uses_rotated(F.col("angle"), F.col("b"))).orderBy("k").collect()
    assert [r["u"] for r in flags] == [False, False, False, False]


def test_multimodal_inputs(spark):
    r = spark.range(1).select(training.multimodal_inputs(F.array(F.lit(7)), F.array(F.lit(8), F.lit(9)), F.lit(2), 1, 0, 2).alias("x")).collect()[0]["x"]
    assert r["input_ids"] == [1, 0, 0, 7, 8, 9, 2] and r["token_type_ids"] == [0, 1, 1, 0, 0, 0, 0] and r["labels"] == [-100] * 4 + [8, 9, 2]


def test_inference_loads_a_model_for_each_task(spark):
    df = spark.createDataFrame([("q1",), ("q2",)], "query string")
    model = lambda: lambda rows: [r["query"].upper() for r in rows]
    assert sorted(r["response"] for r in training.predicted(df, model, ["query"]).collect()) == ["Q1", "Q2"]
    assert training.record(df, "query", "q1").count() == 1
    assert spark.range(1).select(training.as_list(F.array(F.array(F.lit(1)), F.array(F.lit(2))), 2).alias("x")).collect()[0]["x"] == [1, 2]


def test_batches_of_a_whole_table(spark):
    df = spark.range(1000).select("id", F.array_repeat(F.lit(1), (F.col("id") % 5).cast("int")).alias("ids")).repartition(7)
    rows = training.collated(df, "id", "ids", 16, 0).collect()
    assert all(r["batch"] == r["id"] // 16 and len(r["input_ids"]) == 4 for r in rows) and len(rows) == 1000


@pytest.mark.parametrize("name,special", [("byte_bpe_50k.json", None), ("byte_bpe_multi_50k.tiktoken", {"<|end|>": 50256}), ("piece_bpe_32k.model", None)])
def test_vocabulary_files(spark, name, special):
    path = pytest.importorskip("public_tokenizers").path(name)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(("Hello, tokens!", "zwei Wörter", "", None))], "k int, t string")
    rows = df.withColumn("ids", training.encoded(F.col("t"), path, special=special)).withColumn("back", training.decoded(F.col("ids"), path, special=special)).orderBy("k").collect()
    assert [r["back"] for r in rows] == ["Hello, tokens!", "zwei Wörter", "", ""] and len(rows[0]["ids"]) > 2 and rows[3]["ids"] == []
    if special:
        assert df.select(training.encoded(F.lit("a<|end|>"), path, special=special).alias("ids")).collect()[0]["ids"][-1] == 50256
    with pytest.raises(ValueError):
        training.Codec("vocab.txt")


def test_one_item_is_encoded(spark):
    df = spark.createDataFrame([("1", '{"a": "x"}', 90.0), ("2", '{"a": "y"}', 0.0)], "id string, ground_truth string, angle double")
    found = training.record(df, "id", "2", lambda rows: training.items(rows, tokenizer(), length=16, pad=0)).collect()
    assert len(found) == 1 and found[0]["target"] == "<s_a>y</s_a></s>" and len(found[0]["labels"]) == 16


def test_rank_vocabularies_part_texts_by_the_pattern(spark):
    import base64

    import public_tokenizers
    import tiktoken

    from docloom.functions.text import PRE_TOKEN

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    texts = ["12345678 I'LL see\r\n\n  it's 007", "a\n\nb  c\t", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for pattern in (PRE_TOKEN, public_tokenizers.PATTERN):
        plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        found = df.select("k", training.encoded(F.col("t"), path, pattern=pattern).alias("ids")).orderBy("k").collect()
        assert [r["ids"] for r in found] == [plain.encode(t) for t in texts]
    own = training.encoded(F.lit(texts[0]), path)
    assert spark.range(1).select(own).first()[0] != plain.encode(texts[0])  # another pattern, other ids
