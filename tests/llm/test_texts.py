"""Toxicity, WARC, substring dedup, line dedup and quality: brute force, held-out accuracy and odd cases."""

import gzip
import json
import math
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from docloom.llm import line_dedup, quality, queries, substring_dedup, toxicity, warc

from .data import empty, odd, odd_rows

DATA = "/root/testdata/sf0.01"


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


# --- toxicity --------------------------------------------------------------------------------------------------------


def plain_words(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def plain_features(text):
    """{(kind, text): words that have it}, without any array."""
    found = Counter()
    for w in plain_words(text):
        found.update([(0, w)] + [(n, w[:n]) for n in (4, 5, 6) if len(w) > n])
    return found


def plain_loss(x, grades, w, t, ridge=1e-6):
    z = x @ w
    cut = np.concatenate(([-np.inf], t, [np.inf]))
    p = 1 / (1 + np.exp(-(cut[grades + 1] - z))) - 1 / (1 + np.exp(-(cut[grades] - z)))
    return -np.log(p).mean() + ridge / 2 * (w @ w)


def test_toxicity_matches_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(toxicity.keyed(docs), toxicity.graded(labels))
    held, grade = texts(spark), {r["doc_id"]: (1 + (r["quality"] == 0) if r["toxic"] else 0) for r in labels.collect()}
    found = {d: plain_features(t) for d, t in held.items()}
    seen = (Counter(), Counter())  # the features, from counts over all labelled rows
    for d, g in grade.items():
        seen[g > 0].update(found[d].keys())
    clean, toxic = (sum((g > 0) == v for g in grade.values()) for v in (False, True))
    n, chosen = clean + toxic, []
    for f, a in seen[1].items():
        b = seen[0][f]
        chi = n * (a * (clean - b) - b * (toxic - a)) ** 2 / ((a + b) * (n - a - b + 1) * toxic * clean)
        if a >= toxicity.SUPPORT and ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1)) >= toxicity.ODDS and chi >= toxicity.CHI:
            chosen.append((-chi, f))
    assert list(model.index) == [f for _, f in sorted(chosen)] and len(chosen) < toxicity.FEATURES
    width, rows = len(model.index), {}
    for d, own in found.items():
        x, total = np.zeros(2 * width), len(plain_words(held[d]))
        for f, k in model.index.items():
            if own[f]:
                x[k], x[width + k] = 1, min(1, 10 * own[f] / total)
        rows[d] = x
    out = {r["doc_id"]: r for r in queries.op1_ordinal_toxicity(spark, DATA).collect()}
    assert len(model.thresholds) == max(grade.values()) == 2 and out.keys() == held.keys()
    for d, x in rows.items():
        p = 1 / (1 + np.exp(-(x @ model.weights - model.thresholds)))
        assert np.isclose(out[d]["severity"], p.sum(), atol=1e-9) and np.isclose(out[d]["p_toxic"], p[0], atol=1e-9)
        assert out[d]["grade"] == (p >= 0.5).sum() and out[d]["toxic"] == (p[0] >= 0.5)
    ids = sorted(grade)
    x, g = np.array([rows[d] for d in ids]), np.array([grade[d] for d in ids])
    base = plain_loss(x, g, np.zeros(2 * width), np.array([np.log(clean / toxic), np.log((n - (g == 2).sum()) / (g == 2).sum())]))
    assert plain_loss(x, g, model.weights, model.thresholds) < 0.5 * base


def test_toxicity_finds_labelled_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = queries.op1_ordinal_toxicity(spark, DATA).collect()
    assert len(rows) == 1000
    pairs = Counter((labels[r["doc_id"]], r["toxic"]) for r in rows if r["doc_id"] in labels)
    assert pairs[0, True] == 0 and pairs[1, True] >= 0.6 * (pairs[1, True] + pairs[1, False])
    assert all(0 <= r["severity"] <= 2 and r["toxic"] == (r["p_toxic"] >= 0.5) == (r["grade"] > 0) for r in rows)


def test_toxicity_on_rows_not_fitted(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = F.col("doc_id") % 4 != 0
    model = toxicity.fit(toxicity.keyed(docs), toxicity.graded(labels.filter(seen)))
    found = toxicity.severity(docs.join(labels.filter(~seen).select("doc_id", F.col("toxic").alias("label")), "doc_id"), model).select("label", "toxic").collect()
    n = Counter((r["label"], r["toxic"]) for r in found)
    assert n[0, True] <= 0.005 * (n[0, True] + n[0, False]) and n[1, True] >= 0.85 * (n[1, True] + n[1, False])


def test_ordinal_fit_shares_weights_and_orders_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    z = x @ np.array([2.0, -1.0]) + rng.logistic(size=3000)
    grades = np.digitize(z, [0.0, 1.5, 3.0])
    rows, cols = np.divmod(np.arange(6000), 2)
    w, t = toxicity.fit_ordinal(rows, cols, x.ravel(), grades, 2, steps=1500)
    assert np.allclose(w, [2, -1], atol=0.25) and np.allclose(t, [0, 1.5, 3], atol=0.3) and (np.diff(t) > 0).all()
    least = plain_loss(x, grades, w, t)
    for k in range(5):  # the least loss: it rises either way along each weight and threshold
        for step in (-0.02, 0.02):
            both = np.concatenate((w, t))
            both[k] += step
            assert plain_loss(x, grades, both[:2], both[2:]) > least


def test_severity_grades_expect_what_texts_of_that_grade_have(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(900):  # severity shows in the words; the grades are given, with some noise
        g = k % 4
        words = [f"plain{x}" for x in rng.choice(list("abcdefgh"), 30)] + [f"mark{'uvw'[j]}" for j in range(3) if g > j and rng.random() < 0.9]
        rows.append((k, " ".join(rng.permutation(words)), g))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    model = toxicity.fit(toxicity.keyed(df), df.selectExpr("doc_id AS id", "grade").filter("id % 5 > 0"))
    out = toxicity.severity(df.filter("doc_id % 5 = 0").withColumnRenamed("grade", "true"), model).groupBy("true").agg(F.avg("severity").alias("s")).orderBy("true").collect()
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    assert (np.diff([r["s"] for r in out]) > 0.4).all() and out[0]["s"] < 0.3 and out[3]["s"] > 2.2


def test_words_are_runs_of_letters():
    held = ["", None, "  ", "É1é_a-b\n漢字 x", "ab'cd " * 3, "12 34"]
    rows, at, words = toxicity.words_of(pa.array(held))
    assert [[words[j] for k, j in zip(rows, at) if k == n] for n in range(len(held))] == [plain_words(t) for t in held]


def test_toxicity_odd_cases(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (8, 0, None), (6, 1, 0), (None, 1, 1), (2, None, 0), (6, 0, 1)], "doc_id bigint, toxic int, quality int")
    assert sorted((r["id"], r["grade"]) for r in toxicity.graded(labels).collect()) == [(5, 1), (6, 0), (6, 2), (7, 0), (8, 0)]
    assert {r["grade"] for r in toxicity.graded(labels.drop("quality")).collect()} == {0, 1}
    model = toxicity.fit(toxicity.keyed(docs), toxicity.graded(labels))
    assert len(model.thresholds) == 2
    for m in (None, model):
        out = toxicity.severity(docs, m)
        assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-4:] == ["severity_", "grade_", "p_toxic_", "toxic_"]
        assert out.count() == len(odd_rows()) and out.filter("severity_ IS NULL").count() == 0
    assert toxicity.severity(empty(spark), None).count() == 0
    assert toxicity.fit(toxicity.keyed(empty(spark)), toxicity.graded(labels)) is None
    assert toxicity.fit(toxicity.keyed(docs), toxicity.graded(labels.filter("toxic = 1"))) is None


def test_one_text_of_each_sampled_id(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(300)] + [(2, "other"), (3, None)], "id bigint, text string")
    grades = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1)], "id bigint, grade int")
    assert toxicity._sampled(docs, grades, 10).count() == 3
    assert toxicity._sampled(docs, grades, 1).count() <= 2


# --- WARC ------------------------------------------------------------------------------------------------------------


class Reader(HTMLParser):
    """An independent reading of links, title and text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.text, self.skip, self.title, self.in_title = [], [], 0, "", False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])
        self.in_title = tag == "title"
        if tag not in ("a", "b", "span"):
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        self.in_title = False
        if tag not in ("a", "b", "span"):
            self.text.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.in_title:
                self.title += data


def test_warc_derivatives_match_another_parser(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    held = {r["page_id"]: r for r in pages.collect()}
    rows = warc.derive(warc.responses_of(pages, "page_id", "url", "html", queries.CRAWLED), ["page_id"]).collect()
    assert len(rows) == 2 * len(held)
    by = defaultdict(dict)
    for r in rows:
        by[r["page_id"]][r["record_type"]] = r
    for page, kinds in by.items():
        meta, text = kinds["metadata"], kinds["conversion"]
        reader = Reader()
        reader.feed(held[page]["html"])
        body = json.loads(meta["block"])["Envelope"]
        found = body["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert [x["url"] for x in found["HTML-Metadata"]["Links"] if x["path"] == "A@/href"] == reader.links
        assert found["HTML-Metadata"]["Title"] == " ".join(reader.title.split())
        assert ["Content-Type", "text/html; charset=utf-8"] in found["Headers"]
        assert "".join(text["block"].split()) == "".join("".join(reader.text).split())
        assert meta["refers_to"] == text["refers_to"] == body["WARC-Header-Metadata"]["WARC-Record-ID"]
        assert meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
        assert body["Payload-Metadata"]["Payload-Digest"] == meta["source_payload_digest"] == warc.digest(held[page]["html"].encode())
        for r in (meta, text):
            assert r["block_digest"] == warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())


def members(data):
    """The gzip members of a file, each unpacked."""
    while data:
        unzip = zlib.decompressobj(31)
        yield unzip.decompress(data) + unzip.flush()
        data = unzip.unused_data


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/é", "<p>é&amp;<a href='/y'>z</a>"), (2, "http://y", "<p>two")], "page_id bigint, url string, html string").coalesce(1)
    records = warc.derive(warc.responses_of(pages, "page_id", "url", "html", "2024-01-01T00:00:00Z"))
    warc.write_warc(records, f"{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    whole = list(members(file.read_bytes()))
    assert len(whole) == 4 and all(m.startswith(b"WARC/1.0\r\n") and m.endswith(b"\r\n\r\n") for m in whole)
    found = [(dict(h), b) for h, b in warc.parse_warc(b"".join(whole).split(b"WARC/1."))]
    assert [h["WARC-Type"] for h, _ in found] == ["metadata", "conversion"] * 2
    assert all(len(b) == int(h["Content-Length"]) and warc.digest(b) == h["WARC-Block-Digest"] for h, b in found)
    assert found[1][1].decode() == "é&z" and found[1][0]["WARC-Payload-Digest"] == warc.digest("<p>é&amp;<a href='/y'>z</a>".encode())
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9 WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n"
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:KEPT\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    other = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    cut = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nHTTP/1.1 200"
    for name, data in (("in.warc", raw + other + cut), ("one.warc.gz", gzip.compress(raw + other + raw)), ("many.warc.gz", gzip.compress(raw) + gzip.compress(other) + gzip.compress(raw))):
        (tmp_path / name).write_bytes(data)
        held = warc.read_responses(spark, f"{tmp_path}/{name}").collect()
        assert [bytes(r["payload"]) for r in held] == [http.partition(b"\r\n\r\n")[2]] * (1 if name == "in.warc" else 2)
        rows = {r["record_type"]: r for r in warc.derive(warc.read_responses(spark, f"{tmp_path}/{name}")).collect()}
        assert rows["conversion"]["block"].startswith("é WARC/1.0") and rows["conversion"]["refers_to"] == "<urn:uuid:1>"
        assert rows["metadata"]["source_payload_digest"] == "sha1:KEPT" and json.loads(rows["metadata"]["block"])["Envelope"]["WARC-Header-Metadata"]["WARC-Payload-Digest"] == "sha1:KEPT"


def chunked(data, size=7):
    parts = [data[k : k + size] for k in range(0, len(data), size)]
    return b"".join(b"%x;a=b\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def deflated(data, bits):
    pack = zlib.compressobj(wbits=bits)
    return pack.compress(data) + pack.flush()


PAGE = "<title>é</title><p>one <a href='/x'>two</a>".encode()
TOLD = "é\none two"


@pytest.mark.parametrize("headers,payload,text", [
    ("Content-Type: text/html; charset=utf-8\r\ncontent-encoding: gzip", gzip.compress(PAGE), TOLD),
    ("Content-Type: text/html\r\nContent-Encoding: x-gzip\r\nTransfer-Encoding: chunked", chunked(gzip.compress(PAGE[:9]) + gzip.compress(PAGE[9:])), TOLD),
    ("Content-Type: text/html\r\nTransfer-Encoding: chunked", chunked(PAGE), TOLD),
    ("Content-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", PAGE, TOLD),  # undone by the crawler
    ("Content-Type: text/html\r\nContent-Encoding: deflate", deflated(PAGE, 15), TOLD),
    ("Content-Type: text/html\r\nContent-Encoding: deflate, gzip", gzip.compress(deflated(PAGE, -15)), TOLD),
    ("Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(b"<p>" + b"whole " * 9000)[:-60], None),  # cut off
    ("", PAGE, TOLD),
    ("Content-Type: text/plain", b"<b> as it is", "<b> as it is"),
    ("Content-Type: application/xhtml+xml", PAGE, TOLD),
    ("Content-Type: image/png", b"\x89PNG <p>no", ""),
    ("Content-Type: application/pdf", b"%PDF <p>no", ""),
    ("", b"\0\1\2<p>no", ""),
    ("Content-Type: text/html\r\nContent-Encoding: br", b"\x0b\x02", ""),
])
def test_warc_bodies_are_undone(spark, headers, payload, text):
    df = spark.createDataFrame([("<urn:uuid:1>", "http://x", "d", None, 200, headers, bytearray(payload), None, None)], warc.RESPONSE)
    rows = {r["record_type"]: r for r in warc.derive(df).collect()}
    meta = json.loads(rows["metadata"]["block"])["Envelope"]["Payload-Metadata"]
    assert meta["Payload-Digest"] == warc.digest(payload) and meta["Payload-Length"] == len(payload)
    if text == "":
        assert set(rows) == {"metadata"} and rows["metadata"]["concurrent_to"] is None
    else:
        assert rows["metadata"]["concurrent_to"] == rows["conversion"]["record_id"]
        assert rows["conversion"]["block"] == text or text is None and rows["conversion"]["block"].startswith("whole whole")


def test_warc_headers_are_kept_in_order(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\ncontent-type: text/html\r\nSet-Cookie: b\r\n\r\n<p>x"
    raw = b"WARC/1.0\r\nwarc-type: Response\r\nwarc-record-id: <urn:uuid:9>\r\nWARC-Concurrent-To: <1>\r\nWARC-Concurrent-To: <2>\r\nWARC-TARGET-URI: http://y\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    (tmp_path / "a.warc").write_bytes(raw)
    (row,) = warc.read_responses(spark, f"{tmp_path}/a.warc").collect()
    assert (row["record_id"], row["target_uri"], row["http_status"]) == ("<urn:uuid:9>", "http://y", 200)
    meta = next(r for r in warc.derive(warc.read_responses(spark, f"{tmp_path}/a.warc")).collect() if r["record_type"] == "metadata")
    told = json.loads(meta["block"])["Envelope"]
    assert [v for k, v in told["WARC-Headers"] if k == "WARC-Concurrent-To"] == ["<1>", "<2>"] and told["WARC-Headers"][0] == ["warc-type", "Response"]
    assert told["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"] == [["Set-Cookie", "a"], ["content-type", "text/html"], ["Set-Cookie", "b"]]


def test_warc_members_of_large_records():
    for text in ("x", "y" * ((1 << 24) + 5)):
        assert b"".join(members(warc._member(text) + b"\0")) == text.encode() + b"\r\n\r\n"


def test_warc_files_are_read_as_a_stream(spark, tmp_path):
    """200 MB of responses in a file of a few hundred kB; no task holds more than some records."""
    block = b"HTTP/1.1 200 OK\r\n\r\n<p>" + b"word " * 200_000
    one = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block))
    (tmp_path / "big.warc.gz").write_bytes(one * 200)

    def most(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(x.nbytes for x in batches)])], ["most"])

    found = warc.read_responses(spark, f"{tmp_path}/big.warc.gz")
    assert found.count() == 200 and found.mapInArrow(most, "most bigint").agg(F.max("most")).collect()[0][0] < 70 << 20


def test_hostile_pages_take_linear_time():
    for piece in ("<a ", "<", "<a href=\"", "<a b='", "</", "<!--", "<!", "<script ", "<script>", "</script", "<a =", "= ", "<title>", "<a><a href=x>", "&", "<a \"'"):
        page = piece * (1_000_000 // len(piece))
        began = time.perf_counter()
        warc.extract(page)
        assert time.perf_counter() - began < 5, piece
    began = time.perf_counter()
    assert warc.extract("text <a " + "<a " * 330_000)[0] == "text" and time.perf_counter() - began < 1


def test_warc_odd_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<"), (4, "u", "<!-- open"), (5, "u", "<script>x"), (6, "u", "<a href=>t</a><a>n</a>"), (7, "u", "<p>" + "x " * 200_000), (7, "u", "<title>t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("block", F.lit(1)).withColumn("record_id", F.lit("r"))
    out = warc.derive(warc.responses_of(pages, "page_id", "url", "html", "d"), ["page_id"]).collect()
    assert len(out) == 2 * len(rows)
    text = {r["page_id"]: r["block"] for r in out if r["record_type"] == "conversion"}
    assert text[1] == text[2] == text[4] == text[5] == "" and text[3] == "<" and text[6] == "tn"
    assert warc.derive(warc.responses_of(pages.limit(0), "page_id", "url", "html", "d")).count() == 0


# --- substring dedup -------------------------------------------------------------------------------------------------


def brute_repeats(docs: dict[int, str]) -> dict[int, list[tuple[int, int]]]:
    first, out = {}, defaultdict(list)
    occurrences = sorted((i, s, e, d) for i, t in docs.items() for s, e, d in substring_dedup.units(t or ""))
    for i, s, e, d in occurrences:
        if d not in first:
            first[d] = (i, e)
        elif first[d][0] != i or s >= first[d][1]:
            out[i].append((s, e))
        elif e > first[d][1]:
            out[i].append((first[d][1], e))
    merged = {}
    for i, spans in out.items():
        done = []
        for s, e in sorted(spans):
            if done and s <= done[-1][1]:
                done[-1] = (done[-1][0], max(e, done[-1][1]))
            else:
                done.append((s, e))
        merged[i] = done
    return merged


def test_repeats_match_brute_force(spark):
    docs = texts(spark)
    expected = brute_repeats(docs)
    rows = substring_dedup.drop_repeats(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    assert len(rows) == len(docs) and expected
    for r in rows:
        spans = [(s["start"], s["end"]) for s in r["removed_spans"]]
        assert spans == expected.get(r["doc_id"], [])
        t, cut, at = docs[r["doc_id"]], "", 0
        for s, e in spans:
            cut, at = cut + t[at:s], e
        assert r["text"] == cut + t[at:]


def test_passages_inside_lines_are_found_and_clean_texts_stay(spark):
    passage = " ".join(f"Sentence {k} of a passage that was copied says a thing or two." for k in range(6))
    rows = [(1, f"An opening. {passage} An end."), (2, f"Quite another start was here. {passage}"), (3, "Short. Lines.\nShort. Lines."), (4, f"A paragraph.\n\n{passage}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in substring_dedup.drop_repeats(df).collect()}
    assert out[1]["text"] == rows[0][1] and out[3]["text"] == rows[2][1]
    assert out[2]["text"].strip() == "Quite another start was here." and passage not in out[4]["text"]
    again = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(df, unit="paragraph").collect()}
    assert again[4].strip() == "A paragraph." and again[3] == rows[2][1]


def test_passages_across_short_lines_and_their_ends_are_found(spark):
    verse = "\n".join(f"Line {k} of a verse has seven words" for k in range(8))
    long = "This sentence of the passage has a good many more words in it than the twenty that a unit must have."
    ending = f"{long} Its end is short."
    han = "".join(chr(0x4E00 + 7 * k) for k in range(30)) + "。"
    rows = [(1, f"Start.\n{verse}\nOne more."), (2, f"Other words here.\n{verse}\nQuite another."), (3, verse), (4, f"{ending} Then one goes on."), (5, f"Before. {ending} Then two stops."), (6, f"{han}\n甲"), (7, f"乙\n{han}")]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(out[k] == dict(rows)[k] for k in (1, 4, 6))
    assert out[2] == "Other words here.\n\nQuite another." and out[3] == ""
    assert out[5] == "Before. Then two stops." and out[7] == "乙\n"


def test_many_spans_of_one_document(spark):
    line = lambda k: " ".join(f"w{k}x{j}" for j in range(21))
    many = "\n".join(f"{line(k)}\nown {k}" for k in range(3000))
    rows = [(1, "\n".join(f"{line(k)}\nother{k}" for k in range(3000))), (2, many)]
    out = {r["doc_id"]: r for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "\n".join(f"\nown {k}" for k in range(3000))
    assert len(out[2]["removed_spans"]) == 3000


def test_every_repeated_line_goes_without_a_floor(spark):
    rows = [(1, "a\nb c\nd"), (2, "x\nb c\na"), (3, "")]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=1).collect()}
    assert out == {1: "a\nb c\nd", 2: "x\n\n", 3: ""}


def test_units_cover_every_shared_run():
    rng = np.random.default_rng(4)
    for _ in range(200):
        run = [" ".join(f"r{k}x{w}" for w in range(int(n))) + rng.choice(["\n", ". "]) for k, n in enumerate(rng.integers(1, 30, int(rng.integers(2, 9))))]
        if len("".join(run).split()) < substring_dedup.MIN_WORDS:
            continue
        shared = "".join(run)
        one, two = f"own words. {shared}then more of it.", f"other. And that\n{shared}last"
        known = {d for *_, d in substring_dedup.units(one)}
        covered = {c for s, e, d in substring_dedup.units(two) if d in known for c in range(s, e)}
        at = two.index(shared)
        assert all(c in covered for c in range(at, at + len(shared)) if not two[c].isspace())


def test_repeats_odd_cases(spark):
    docs = odd(spark)
    out = substring_dedup.drop_repeats(docs)
    assert out.columns == [*docs.columns, "removed_spans_"]
    rows = out.collect()
    assert len(rows) == len(odd_rows())
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[1][0]["text"] is None and by[2][0]["text"] == "" and by[1][0]["removed_spans_"] == []
    assert [r["removed_spans_"] for r in by[5]] == [[], []]
    line = odd_rows()[4][1]
    assert [(s["start"], s["end"]) for s in by[6][0]["removed_spans_"]] == [(0, len(line)), (len(line) + 1, 2 * len(line) + 1)]
    assert substring_dedup.drop_repeats(empty(spark)).count() == 0


# --- line dedup ------------------------------------------------------------------------------------------------------


def test_site_lines_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text").collect()
    pages, seen = Counter(r["source"] for r in docs), Counter()
    for r in docs:
        seen.update((r["source"], x) for x in {x.strip(" \t\r") for x in r["text"].split("\n")} if x)
    bad = {k for k, n in seen.items() if n >= line_dedup.MIN_PAGES and n / pages[k[0]] > line_dedup.RATIO}
    out = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(docs), F.col("source")).collect()}
    assert bad
    for r in docs:
        kept = [x for x in r["text"].split("\n") if (r["source"], x.strip(" \t\r")) not in bad]
        assert out[r["doc_id"]]["text"] == "\n".join(kept)
        assert out[r["doc_id"]]["dropped_lines"] == r["text"].count("\n") + 1 - len(kept)


def test_site_lines_odd_cases(spark):
    docs = odd(spark)
    out = line_dedup.drop_boilerplate(docs, F.col("source"))
    assert out.columns == [*docs.columns, "dropped_lines_"] and out.count() == len(odd_rows())
    assert out.filter("source IS NULL AND dropped_lines_ > 0").count() == 0
    same = spark.createDataFrame([(k, "foot", "h") for k in range(5)] + [(9, None, "h"), (10, "", "h"), (11, "own\nfoot", None)], "doc_id bigint, text string, source string")
    found = {r["doc_id"]: (r["text"], r["dropped_lines"]) for r in line_dedup.drop_boilerplate(same, F.col("source")).collect()}
    assert found[0] == ("", 1) and found[9] == (None, 0) and found[10] == ("", 0) and found[11] == ("own\nfoot", 0)
    small = [(1, "foot\nown", "a"), (2, "foot\nother", "a"), (3, "alone\nhere", "b"), (4, "x\nfoot", "c"), (5, "y\nfoot", "c"), (6, "z\nfoot", "c"), (7, "w", "c")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(spark.createDataFrame(small, "doc_id bigint, text string, source string"), F.col("source")).collect()}
    assert found == {1: "own", 2: "other", 3: "alone\nhere", 4: "x", 5: "y", 6: "z", 7: "w"}
    assert line_dedup.drop_boilerplate(empty(spark), F.col("source")).count() == 0


@pytest.mark.parametrize("url,host", [("https://A.b/c", "a.b"), ("http://u:p@x.y:80/z?q", "x.y"), ("nothing", None), (None, None)])
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(line_dedup.host_of(F.col("u"))).collect()[0][0] == host


# --- quality ---------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = queries.op10_fourier_quality(spark, DATA).collect()
    import zlib

    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    assert np.mean([a > b for a in good for b in bad]) >= 0.95 and np.mean([y == p for y, _, p in held]) >= 0.93


def plain_statistics(text):
    """The statistics in plain words, character by character."""
    text = text or ""
    raw = text.encode()
    n, words, lines = max(len(raw), 1), text.split(), [x for x in text.split("\n") if x.strip()]
    m = max(len(words), 1)
    some = ".,;:'\"()-"
    kinds = [lambda c: c >= 128, lambda c: 97 <= c <= 122, lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c in b" \t", lambda c: c in b"\r\n", lambda c: chr(c) in some, lambda c: c in b"!?"]
    kinds.append(lambda c: c < 128 and not chr(c).isalnum() and not chr(c).isspace() and chr(c) not in some + "!?")
    freq = Counter(raw)
    return [
        *[sum(k * bool(f(c)) for c, k in freq.items()) / n for f in kinds],
        -sum(k / n * math.log2(k / n) for k in freq.values()),
        *[math.log1p(len(x)) for x in (raw, words, lines)],
        len(raw) / m if words else 0,
        math.sqrt(len(set(words)) / m),
        len(set(words)) / math.sqrt(m),
        max(Counter(words).values(), default=0) / m,
        math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / m),
        sum(not w[-1].isalnum() for w in words) / m,
        len(set(lines)) / max(len(lines), 1),
        math.log1p(len(words) / max(len(lines), 1)),
        sum(w.isupper() for w in words) / m,
        sum(not any(c.isalnum() for c in w) for w in words if len(w) < 4) / m,
    ]


def test_quality_matches_brute_force(spark):
    held = texts(spark)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = sorted(held)
    x = np.array([plain_statistics(held[d]) for d in ids])
    fold = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d in ids])
    use = np.array([d in labels for d in ids]) & ~fold
    y = np.array([labels.get(d, 0) for d in ids], float)
    mean, std = x[use].mean(0), x[use].std(0)
    # the cosines, drawn as the operator draws them: the kernel's spectrum is a normal distribution
    rng = np.random.default_rng(11)
    w, b = rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], quality.WIDTH)), rng.uniform(0, 2 * math.pi, quality.WIDTH)
    z = np.clip((x - mean) / np.where(std > 1e-9, std, 1), -6, 6)
    phi = np.concatenate((np.cos(z @ w + b) * math.sqrt(2 / quality.WIDTH), np.ones((len(x), 1))), 1)
    n = use.sum()
    # ridge regression as least squares of an extended system
    root = np.sqrt(np.concatenate((np.full(quality.WIDTH, quality.RIDGE * n + 1e-9), [1e-9])))
    weights = np.linalg.lstsq(np.concatenate((phi[use], np.diag(root))), np.concatenate((y[use], np.zeros(len(root)))), rcond=None)[0]
    raw = np.clip(phi @ weights, -0.5, 1.5)
    # the best non-decreasing means of bins, by their definition: max over starts of min over ends
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(at[use]))
    sums = [y[use & (at == k)].sum() + y[use].mean() * 1e-3 for k in bins]
    counts = [(use & (at == k)).sum() + 1e-3 for k in bins]
    means = [max(min(sum(sums[i : j + 1]) / sum(counts[i : j + 1]) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    score = 0.999 * np.interp((raw + 0.5) / 2 * quality.BINS - 0.5, bins, means) + 0.001 * (raw + 0.5) / 2
    found = {r["doc_id"]: r for r in queries.op10_fourier_quality(spark, DATA).collect()}
    apart = np.array([abs(found[d]["score"] - s) for d, s in zip(ids, score)])
    assert found.keys() == held.keys() and (apart < 1e-5).mean() > 0.99  # a raw score at the edge of a bin may fall to either side
    assert np.mean([found[d]["predicted"] == (s >= 0.3) for d, s in zip(ids, score)]) > 0.995
    assert [found[d]["held_out"] for d in ids] == fold.tolist()


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, quality.STATISTICS))
    phi = quality.Fourier(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), width=20_000)(x)[:, :-1]
    apart = np.square(x[:, None] - x[None]).sum(2)
    assert np.abs(phi @ phi.T - np.exp(-apart / (2 * quality.STATISTICS))).max() < 0.04


def test_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(rng.normal(size=quality.STATISTICS).tolist(), float(k % 2)) for k in range(500)]
    df = spark.createDataFrame(rows, "stats array<double>, label double")
    of = lambda x, y: np.concatenate((x.T @ y, [len(x)]))
    expected = of(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    for n in (1, 7, 60):
        assert np.allclose(quality._summed(df.repartition(n), of), expected)
    assert quality._summed(df.limit(0), of) is None


def test_isotonic_pools_falling_neighbours():
    assert quality.isotonic(np.array([1.0, 0, 2, 3]), np.array([2.0, 2, 2, 3])).tolist() == [0.25, 0.25, 1.0, 1.0]
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 50).astype(float)
    out = quality.isotonic(rng.random(50) * n, n)
    assert len(out) == 50 and (np.diff(out) >= 0).all()


def test_quality_odd_cases(spark):
    labels = spark.createDataFrame([(5, 1), (7, 0), (8, 0), (8, 1), (None, 1), (2, None)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0)):
        rows = quality.scored(odd(spark), known).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0.5 for r in rows)
    assert quality.scored(empty(spark), labels).count() == 0
    assert all(np.isfinite(quality.statistics(t)).all() for _, t, *_ in odd_rows())
