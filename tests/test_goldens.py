"""Hand-derived results of codecs, the field metric, merges, rows, sizes and prompts."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.functions import codec, prompt, sequences as seq, text as tx, vision as vi
from docloom.operators import bpe, field_metric, joins, pages, splits, vocab

GOLD = {
    "材料类型": "电子发票", "票据代码": "50068122", "票据号码": "8250626222", "校验码": "edfdf4", "交款人": "冯xx", "开票日期": "2023年03月16日",
    "费用明细": [{"细项名称": "卫生材料费", "金额": "8.98"}, {"细项名称": "治疗费", "金额": "3.4"}],
    "嵌套0": [{"项目": "检查费", "金额": "50.00"}, {"项目": "化验费", "金额": "60.00"}],
}
PRED = GOLD | {"费用明细": [*GOLD["费用明细"], {"细项名称": "化验费", "金额": "76.5"}]}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_field_metric_golden(spark):
    rows = [(json.dumps(p, ensure_ascii=False), json.dumps(GOLD, ensure_ascii=False)) for p in ({}, PRED, PRED)]
    found = {r["field"]: r for r in field_metric.field_f1(spark.createDataFrame(rows, "pred string, gold string")).collect()}
    as_row = lambda f: tuple(found[f][c] for c in ("right_num", "pred_num", "gt_num", "precision", "recall", "f1"))
    for field in ("材料类型", "票据代码", "票据号码", "校验码", "交款人", "开票日期"):
        assert as_row(field) == (2, 2, 3, 1.0, 0.6667, 0.8)
    for field in ("费用明细-细项名称", "费用明细-金额"):
        assert as_row(field) == (4, 8, 6, 0.5, 0.6667, 0.5714)
    for field in ("嵌套0-项目", "嵌套0-金额"):
        assert as_row(field) == (4, 6, 6, 0.6667, 0.6667, 0.6667)
    assert as_row("total") == (28, 40, 42, 0.7, 0.6667, 0.6829)


def test_field_counts_edges():
    assert field_metric.field_counts({}, {"x": [{"a": "1"}]}) == {"x-a": [0, 1, 1]}
    assert field_metric.field_counts({"x": [{"a": "1"}]}, {}) == {"x-a": [0, 1, 1]}
    assert field_metric.field_counts({"x": None}, {"x": None}) == {"x": [0, 0, 0]}
    # equal likeness: the last row is taken; equal gold rows: the first is marked, so one is counted again
    assert field_metric.field_counts({"x": [{"a": "1"}]}, {"x": [{"a": "1"}, {"a": "1"}]}) == {"x-a": [1, 1, 2]}
    assert field_metric.field_counts({"x": "1"}, {"x": [{"a": "1"}]}) == {"x": [0, 1, 1]}


def test_empty_corpus_has_null_ratios(spark):
    found = field_metric.field_f1(spark.createDataFrame([("{}", "{}")], "pred string, gold string")).collect()
    assert all(r["f1"] is None for r in found)


def test_flattened():
    assert field_metric.flattened({"a": [{"b": 1}, {"b": 2}], "c": 3}) == [("a-0-b", 1), ("a-1-b", 2), ("c", 3)]


def test_line_codec(spark):
    text = codec.lines(GOLD | {"嵌套1": {"嵌套2": [{"项目": "检查费", "金额": "70.00"}]}})
    assert text.startswith("材料类型:电子发票\n\n票据代码:50068122")
    assert "费用明细-细项名称:治疗费\t\t费用明细-金额:3.4" in text
    assert text.endswith("嵌套1-嵌套2-项目:检查费\t\t嵌套1-嵌套2-金额:70.00")
    back = codec.unlined(text, prefix=True)
    assert back["费用明细"] == GOLD["费用明细"] and back["嵌套1"] == [{"嵌套2-项目": "检查费", "嵌套2-金额": "70.00"}]
    assert codec.lines([{"项目1": "检查费", "金额": "50.00"}]) == "项目1:检查费\t\t金额:50.00"
    assert codec.unlined(codec.lines({"x": [{"k": "1"}, {"k": "2"}]})) == {"x-k": "2"}
    native = one(spark, codec.lines_v2(F.lit(json.dumps(GOLD, ensure_ascii=False))))
    assert native == codec.lines(GOLD)
    parsed = one(spark, codec.parsed_v2(F.lit(codec.lines(GOLD, prefix=False))))
    expected = codec.unlined(codec.lines(GOLD, prefix=False))
    assert parsed["fields"] == {k: v for k, v in expected.items() if k != "groups"} and parsed["groups"] == expected["groups"]


def test_tag_codec(spark):
    doc = {"gt_parse": {"text_sequence": "A</n>B"}}
    assert codec.tags(doc) == "<s_gt_parse><s_text_sequence>A</n>B</s_text_sequence></s_gt_parse>"
    assert codec.untagged(codec.tags(doc)) == doc
    assert codec.untagged("plain") == {"text_sequence": "plain"}
    assert codec.untagged("<s_a>1</s_a><sep/><s_a>2</s_a>") == [{"a": "1"}, {"a": "2"}]
    assert codec.untagged("<s_a>x<sep/>y</s_a>") == {"a": ["x", "y"]}
    assert codec.untagged("<s_a><yes/></s_a>", frozenset({"<yes/>"})) == {"a": "yes"}
    assert codec.untagged("<s_b><s_a>1</s_a>") == {"a": "1"}
    deep = {"a": {"b": {"c": "1"}, "d": ["2", "3"]}, "e": [{"f": "4"}, {"f": "5", "g": {"h": "6"}}]}
    assert codec.untagged(codec.tags(deep)) == deep
    assert codec.untagged("<s_gt_parse><s_text_sequence>CD</n>2 /x</s_text_sequence></s_gt_parse>") == {"gt_parse": {"text_sequence": "CD</n>2 /x"}}
    # broken: a tag without its end is passed over, an end without its tag is text, an item ends what it holds
    assert codec.untagged("<s_a>x<s_b>y</s_a>") == {"a": "x<s_b>y"}
    assert codec.untagged("<s_a><s_b><s_c>1</s_c></s_a><s_d>2</s_d>") == {"a": {"c": "1"}, "d": "2"}
    assert codec.untagged("<s_a>1</s_b></s_a> between <s_b>2</s_b><sep/>") == [{"a": "1</s_b>", "b": "2"}]
    assert codec.untagged("<s_a><s_a>x</s_a></s_a>") == {"a": "<s_a>x"}
    assert codec.untagged("<s_a><s_b>x</s_c></s_a><s_d>1\n2</s_d>") == {"d": "1\n2"}
    assert codec.untagged("<s_A>1</s_a>") == {"A": "1"} and codec.untagged("<s_b>open") == {"text_sequence": "open"}
    assert len(codec.untagged("<s_a>" * 100_000 + "x" + "<s_b>" * 100_000)["text_sequence"]) == 1
    assert codec.tags({"b": None, "a": True}) == "<s_a>True</s_a><s_b>None</s_b>"
    assert one(spark, codec.flat_tags(F.lit('{"b": null, "a": "1"}'))) == "<s_a>1</s_a><s_b>None</s_b>"


def test_loose_codec(spark):
    assert codec.loosened({"b": "1", "票": ""}, drop=frozenset({"x"})) == '{b:1,票:""}'
    assert one(spark, codec.loose_v1(F.lit(json.dumps({"b": "1", "票": ""}, ensure_ascii=False)))) == '{b:1,票:""}'
    assert codec.unloose("{") is None
    assert codec.unloose("{a:1,b:[{c:x y},{c:z,d:{e:f}}],g:[]}") == {"a": "1", "b": [{"c": "x y"}, {"c": "z", "d": {"e": "f"}}], "g": []}
    assert codec.unloose("{a:x,no colon,b: y }") == {"a": "x", "b": " y "} and codec.unloose("{a:(:x}") == {"a": "(: x"}
    for broken in ("a:b", "{a:1:2}", "{a:}", "{a:x{b:y}}", "[a:b]", "{a:[b,c],d:e}", "{a:b}{c:d}", '{a:"}', "{a-b:c}", "{a:b]", "{{a:b}}", "{a:b,c:d,}", ""):
        assert codec.unloose(broken) is None


def test_key_functions():
    v = {"a": 1, "b": [{"a": 2, "c": 3}]}
    assert codec.without(v, frozenset({"a"})) == {"b": [{"c": 3}]}
    assert codec.mapped(v, {"b": "x", "c": "y"}) == {"x": [{"y": 3}]}
    assert codec.keys_of(v) == {"a", "b", "c"}
    ids = {"a": 0}
    assert codec.numbered(v, ids) is v and ids == {"a": 0, "b": 1, "c": 2}
    assert codec.numbered({"a": 1}, {"a": 0}, fixed=True) == {0: 1}
    with pytest.raises(ValueError):
        codec.numbered(v, {})


def test_merges_golden(spark):
    rows = [(0, "low", ["l", "o", "w", "</w>"], 5), (1, "lower", [*"lower", "</w>"], 2), (2, "newest", [*"newest", "</w>"], 6), (3, "widest", [*"widest", "</w>"], 3)]
    v = spark.createDataFrame(rows, "n int, word string, symbols array<string>, freq bigint")
    assert {r["token"]: r["freq"] for r in vocab.token_counts(v).collect()} == {"l": 7, "o": 7, "w": 16, "</w>": 16, "e": 17, "r": 2, "n": 6, "s": 9, "t": 9, "i": 3, "d": 3}
    assert [a + b for a, b, _ in vocab.trained_merges(v, 5, order="n")] == ["es", "est", "est</w>", "lo", "low"]


def test_merged_symbols_do_not_overlap(spark):
    rows = spark.createDataFrame([(list("aaab"),), (list("bcaabc"),), ([],)], "symbols array<string>")
    assert [r["new"] for r in bpe.merged(rows, [("a", "a"), ("b", "c")]).collect()] == [["aa", "a", "b"], ["bc", "aa", "bc"], []]


def test_split_sizes(spark):
    rows = [(k, "/book/Label.txt") for k in range(100)] + [(k, "/x/Label.txt") for k in range(100, 200)] + [(k, "/y/Label.txt") for k in range(200, 210)]
    found = Counter((r["file"], r["usage"]) for r in splits.split(spark.createDataFrame(rows, "id int, file string"), "file", "id").collect())
    assert (found["/book/Label.txt", "validation"], found["/book/Label.txt", "test"], found["/book/Label.txt", "train"]) == (2, 2, 96)
    assert (found["/x/Label.txt", "validation"], found["/x/Label.txt", "test"], found["/x/Label.txt", "train"]) == (5, 5, 90)
    assert found["/y/Label.txt", "train"] == 10


def test_val_topup_leaks_unless_told(spark):
    val, test = spark.range(10).toDF("k"), spark.range(100, 500).toDF("k")
    v, t = splits.topped_up(val, test, "k")
    assert v.count() == 300 and t.count() == 400
    v, t = splits.topped_up(val, test, "k", leak_free=True)
    assert v.count() == 300 and t.count() == 110 and v.join(t, "k").count() == 0
    assert splits.topped_up(spark.range(1000).toDF("k"), test, "k")[0].count() == 300


def test_sizes_golden(spark):
    s = one(spark, vi.smart_resize(F.lit(1000), F.lit(747)))
    assert (s["h"], s["w"]) == (1008, 756)
    assert one(spark, vi.smart_resize(F.lit(10), F.lit(747))) is None
    assert one(spark, vi.smart_resize(F.lit(28), F.lit(28 * 201))) is None
    g = one(spark, vi.closest_grid(F.lit(1000), F.lit(747)))
    assert (g["across"], g["down"]) == (4, 3)
    boxes = one(spark, vi.tile_boxes(vi.closest_grid(F.lit(1000), F.lit(747))))
    assert len(boxes) == 13 and tuple(boxes[5]) == (448, 448, 896, 896) and tuple(boxes[12]) == (0, 0, 448, 448)
    assert one(spark, vi.frame_indices(F.lit(100), F.lit(25.0), 4)) == [12, 37, 62, 87]


def test_grid_positions_golden(spark):
    found = one(spark, seq.grid_positions(F.lit(3), F.lit(2), F.lit(2), F.lit(0)))
    assert [p["t"] for p in found] == [0] * 4 + [1] * 4 + [2] * 4
    assert [p["h"] for p in found] == [0, 0, 1, 1] * 3 and [p["w"] for p in found] == [0, 1] * 6
    assert [tuple(p) for p in one(spark, seq.text_positions(F.lit(2), F.lit(3)))] == [(3, 3, 3), (4, 4, 4)]


def box(x, y, w=10, h=10):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def test_page_rows():
    page = [("a", box(0, 0)), ("b", box(20, 1)), ("c", box(0, 40))]
    assert pages.text_rows(page) == [[0, 1], [2]] == pages.text_rows(page, fixed=True)
    assert pages.text_rows([]) == [[]]
    many = [(str(k), box(k % 5 * 30, k // 5 * 30)) for k in range(25)]
    assert sorted(p for row in pages.text_rows(many, fixed=True) for p in row) == list(range(25))
    with pytest.raises(ValueError):
        pages.text_rows([("a", [[0, 0]])], fixed=True)


@pytest.mark.parametrize("a,b", [("", ""), ("abc", "cab"), ("aab", "abb"), ("票据", "据x"), ("a", "")])
def test_quick_ratio_is_the_multiset_ratio(spark, a, b):
    assert one(spark, tx.quick_ratio(F.lit(a), F.lit(b))) == pytest.approx(field_metric.likeness(a, b))


def test_text_functions(spark):
    assert one(spark, tx.edit_similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, tx.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, tx.decoded(F.lit("<s_t> <s_a> x </s_a></s><pad>"))) == "<s_a>x</s_a>"
    assert one(spark, tx.linux_path(F.lit("J:\\a\\b.jpg"))) == "/mnt/j/a/b.jpg"
    assert one(spark, tx.stem(F.lit("/a/b.c.jpg"))) == "b.c"
    assert [one(spark, tx.chinese_or_letters(F.lit(t))) for t in ("票a", "a1", "")] == [True, False, False]
    assert [one(spark, tx.extended_valid(F.lit(t))) for t in ("票a1,∞[", "é")] == [True, False]
    assert one(spark, tx.pre_tokens(F.lit("it's 12345 ok!"))) == ["it", "'s", " ", "123", "45", " ok", "!"]


def test_sequence_functions(spark):
    ids = F.array(*map(F.lit, [5, 9, 7, 2]))
    assert one(spark, seq.label_mask(ids, 9)) == [-100, -100, 7, 2]
    assert one(spark, seq.label_mask_shifted(ids, 7)) == [-100, 7, 2]
    assert one(spark, seq.label_mask(ids, 1)) is None
    assert one(spark, seq.left_padded(ids, F.lit(6), 0)) == [0, 0, 5, 9, 7, 2]
    assert one(spark, seq.position_ids(ids, F.lit(6))) == [0, 0, 0, 1, 2, 3]
    assert one(spark, seq.causal_mask(F.lit(2))) == [[1, 0], [1, 1]]
    assert one(spark, seq.vision_expert(F.array(*map(F.lit, [0, 1, 1, 0, 1])))) == [False, True, False, False, False]
    assert [tuple(p) for p in one(spark, seq.merged_ids(F.lit(2), F.lit(4)))][:6] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (0, 3)]
    assert seq.vision_pads(1120, 14) == 1602


def messages(*texts):
    return F.array(*[F.struct(F.lit(("USER", "ASSISTANT")[k % 2]).alias("role"), F.lit(t).cast("string").alias("text")) for k, t in enumerate(texts)])


def test_prompts(spark):
    t = prompt.template("internlm2-chat", system_message="S")
    named = F.array(*[F.struct(F.lit(t.roles[k % 2]).alias("role"), F.lit(x).cast("string").alias("text")) for k, x in enumerate(("hi", None))])
    assert one(spark, prompt.render(named, t)) == "<|im_start|>system\nS<|im_end|><|im_start|>user\nhi<|im_end|><|im_start|>assistant\n"
    llama = prompt.Template("l", "llama2", sep=" ", sep2=" </s>", roles=("[INST]", "[/INST]"))
    assert one(spark, prompt.render(messages("a", "b", "c", None), llama)) == "[INST] a [/INST] b </s>[INST] c [/INST]"
    glm = prompt.Template("chatglm2", "chatglm", sep="\n", roles=("问", "答"))
    assert one(spark, prompt.render(messages("a", None), glm)) == "[Round 1]\nUSER：a\nASSISTANT："
    assert one(spark, prompt.glm_history(messages("a", "b", "c"))) == "a<|assistant|>b<|endoftext|><|user|>c<|assistant|>"
    assert one(spark, prompt.vqa_history(messages("a", "b", "c"), "chat")) == "Question: a Answer: b\nQuestion: c Answer:"
    assert one(spark, prompt.image_tokens(F.lit("<image>x<image>y<image>"), F.array(F.lit(1), F.lit(2)), 2)) == "<img><IMG_CONTEXT><IMG_CONTEXT></img>x<img>" + "<IMG_CONTEXT>" * 4 + "</img>y<image>"
    with pytest.raises(ValueError):
        prompt.register(t)
    prompt.register(prompt.template("phi3-chat"), override=True)
    assert [tuple(x) for x in one(spark, prompt.openai_messages(messages("a", None), F.lit(None).cast("string")))] == [("system", ""), ("user", "a")]


def test_pairs_need_both_sides(spark):
    a, b = (spark.createDataFrame([(k, c) for k in ids], f"id int, {c} string") for ids, c in (((1, 2), "p"), ((1, 2, 3), "g")))
    assert joins.paired(a, b.filter("id < 3"), "id").orderBy("id").collect()[1].asDict() == {"id": 2, "p": "p", "g": "g"}
    for one, two in ((a, b), (b, a)):
        with pytest.raises(Exception, match="without its counterpart: 3"):
            joins.paired(one, two, "id").collect()


def test_glm_and_minicpm_templates_check_roles(spark):
    schema = "items array<struct<role:string,metadata:string,content:string,image:boolean>>"
    turn = lambda role, content, image=False: (role, "", content, image)

    def glm(*turns, tools=None, **how):
        df = spark.createDataFrame([(list(turns),)], schema)
        told = None if tools is None else F.array(*[F.lit(t) for t in tools])
        return df.select(prompt.glm_template(F.col("items"), tools=told, **how)).collect()[0][0]

    assert glm(turn("user", "q"), turn("assistant", ""), turn("observation", "o")) == "[gMASK]<sop><|user|>\nq<|observation|>\no<|assistant|>"
    assert glm(turn("user", "q", True), image=True, special=False, generate=False) == f"<|user|>\n{prompt.GLM_IMAGE}q"
    told = glm(turn("user", "q"), tools=['[{"type": "python"}, {"type": "function", "function": {"name": "f", "x": "文"}}]'], generate=False)
    assert told.startswith(f"[gMASK]<sop><|system|>\n{prompt.GLM_SYSTEM}\n\n## python\n\n") and told.endswith('\n\n## f\n\n{\n    "name": "f",\n    "x": "文"\n}\n' + prompt.GLM_CALL + "<|user|>\nq")
    for bad in (dict(turns=[turn("tool", "x")]), dict(turns=[turn("user", "a", True), turn("user", "b", True)], image=True), dict(turns=[turn("user", "a")], tools=['[{"type": "unknown"}]'])):
        with pytest.raises(Exception):
            glm(*bad.pop("turns"), **bad)

    def minicpm(*turns):
        return spark.createDataFrame([(list(turns),)], "items array<struct<role:string,content:string>>").select(prompt.minicpm_inputs(F.col("items"), "I")).collect()[0][0]

    assert minicpm(("user", "a"), ("user", "b"), ("assistant", "c")) == "<用户>I\na<用户>b<AI>c<AI>"
    for bad in ([("assistant", "a")], [("user", "a"), ("system", "b")]):
        with pytest.raises(Exception):
            minicpm(*bad)


def test_pruned_weights(spark):
    old = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, id bigint")
    new = spark.createDataFrame([("c", 0), ("a", 1)], "token string, id bigint")
    weights = lambda f: spark.createDataFrame([(k, [f * k]) for k in range(3)], "id bigint, row array<double>")
    tables = {"embedding": weights(1.0), "head": weights(10.0)}
    read = lambda df: [r["row"] for r in df.orderBy("new_id").collect()]
    plain = joins.pruned_weights(new, old, tables, "id")
    assert read(plain["embedding"]) == [[2.0], [0.0]] and read(plain["head"]) == [[20.0], [0.0]]
    tied = joins.pruned_weights(new, old, tables, "id", joins.tied)
    assert read(tied["head"]) == [[2.0], [0.0]]
    with pytest.raises(Exception, match="not in the old vocabulary"):
        read(joins.pruned_weights(new.selectExpr("'x' AS token", "id"), old, tables, "id")["head"])
