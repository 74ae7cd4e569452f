"""Properties that hold for any input."""

import difflib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docloom.functions import codec
from docloom.operators import field_metric, pages

value = st.one_of(st.none(), st.text(max_size=6))
rows = st.lists(st.dictionaries(st.sampled_from("abc"), value, max_size=3), max_size=4)
document = st.dictionaries(st.sampled_from(["k1", "k2", "list"]), st.one_of(value, rows), max_size=3)


@given(document, document)
@settings(max_examples=300, deadline=None)
def test_right_is_at_most_predicted_and_true(pred, gold):
    for right, predicted, true in field_metric.field_counts(pred, gold).values():
        assert 0 <= right <= min(predicted, true)


@given(document)
@settings(max_examples=100, deadline=None)
def test_a_document_agrees_with_itself_on_scalars(doc):
    for field, (right, predicted, true) in field_metric.field_counts(doc, doc).items():
        if "-" not in field:
            assert right == predicted == true


@given(st.text(max_size=30), st.text(max_size=30))
def test_likeness_is_the_standard_librarys_and_symmetric(a, b):
    assert field_metric.likeness(a, b) == difflib.SequenceMatcher(None, a, b).quick_ratio() == field_metric.likeness(b, a)


corner = st.tuples(st.integers(0, 900), st.integers(0, 900), st.integers(1, 400), st.integers(1, 60))


@given(st.lists(st.tuples(st.sampled_from(["a", "-", "字"]), corner), max_size=25), st.booleans())
@settings(max_examples=150, deadline=None)
def test_rows_keep_every_box_once(boxes, fixed):
    page = [(t, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]) for t, (x, y, w, h) in boxes]
    assert sorted(k for row in pages.text_rows(page, fixed) for k in row) == list(range(len(page)))


plain = st.text(st.characters(blacklist_characters="<>\t\n\r:-/", blacklist_categories=("Cs", "Cc", "Zl", "Zp", "Zs")), min_size=1, max_size=6)
flat = st.dictionaries(st.from_regex(r"[a-z]{1,4}", fullmatch=True), plain, min_size=1, max_size=4)


@given(flat)
@settings(deadline=None)
def test_flat_documents_come_back_from_tokens(doc):
    assert codec.untagged(codec.tags(doc)) == doc
    assert codec.unlined(codec.lines(doc)) == doc


@given(st.recursive(st.text(max_size=4), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=3), x, max_size=3)), max_leaves=8))
@settings(deadline=None)
def test_decoders_never_fail(v):
    text = codec.tags(v)
    codec.untagged(text)
    codec.unlined(codec.lines(v))
    codec.unloose(codec.loosened(v))
    assert codec.keys_of(codec.without(v, frozenset({"a"}))) <= codec.keys_of(v)


def test_line_tokens_with_repeated_keys(spark):
    """The last of equal keys wins at the place of the first; parts without a colon go; blank texts give nothing."""
    texts = ["", "a:1\nb:2\na:3", "x:1\ty:2\tx:3\n\nz: 4 ", "no colon\n\t\n:\t:x\n a : b : c ", "a:1\t\tb\tc:", "k:v\r\nk2:v2\tq:1\tq:2\tr:\n: :", None]
    p = codec.parsed_v2(F.col("t"))
    ordered = F.struct(F.map_entries(p["fields"]).alias("fields"), F.transform(p["groups"], F.map_entries).alias("groups"))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", ordered.alias("p")).orderBy("k").collect()
    for (_, found), text in zip(rows[:-1], texts):
        told = codec.unlined(text)
        groups = told.pop("groups", [])
        assert [tuple(e) for e in found["fields"]] == list(told.items())
        assert [[tuple(e) for e in g] for g in found["groups"]] == [list(g.items()) for g in groups]
    assert rows[-1]["p"]["fields"] is None and rows[-1]["p"]["groups"] is None
