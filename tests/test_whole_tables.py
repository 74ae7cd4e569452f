"""Queries that cover whole tables, against plain Python."""

import json
from collections import Counter

from docloom.plans import record_queries, registry, text_queries  # noqa: F401


def test_wrapped_truth_of_all_texts(spark, sf):
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = registry.QUERIES["wrapped_truth"](spark, sf).collect()
    assert len(rows) == len(texts) and {r["item_id"]: json.loads(r["truth"]) for r in rows} == {k: {"text_sequence": t} for k, t in texts.items()}


def test_pixel_shuffle_of_all_parts(spark, sf):
    keys = [r["p_partkey"] for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    rows = registry.QUERIES["pixel_shuffle"](spark, sf).collect()
    place = lambda n: (n // 48, n // 6 % 4, n // 24 % 2 * 6 + n // 3 % 2 * 3 + n % 3)
    assert sorted((r["p_partkey"], r["n"], r["h"], r["w"], r["c"]) for r in rows) == sorted((k, n, *place(n)) for k in keys for n in range(48))


def test_embedding_gather_of_all_rows(spark, sf):
    held = sorted(((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()), reverse=True)
    rows = {r["new_id"]: (r["first"], r["last"], r["dims"]) for r in registry.QUERIES["embedding_gather"](spark, sf).collect()}
    assert rows == {k: (float(v[0]), float(v[-1]), len(v)) for k, (_, v) in enumerate(held)}


def plain_rows(boxes):
    """Rows of one page, step by step from the definition, for boxes whose corners are LU, LD, RD, RU."""
    centre = lambda b: [sum(p[k] for p in b["points"]) / 4 for k in (0, 1)]

    def rows_at(slope, places):
        bias = {k: centre(boxes[k])[1] - centre(boxes[k])[0] * slope for k in places}
        rows, row = [], []
        for k in sorted(places, key=bias.get):
            lu, ld, rd, ru = boxes[k]["points"]
            fits = False
            if row:
                mean = sum(bias[j] for j in row) / len(row)
                heights = [abs(boxes[j]["points"][0][1] - boxes[j]["points"][1][1]) for j in row if any(c.isalnum() or c == "_" for c in boxes[j]["text"])]
                off, height = abs(bias[k] - mean), sum(heights) / len(heights) if heights else 0
                fits = off / height <= 0.7 if height > 0 else off < 12
                for j in row:
                    a, z = boxes[j]["points"][0][0], boxes[j]["points"][3][0]
                    least = min(z - a, ru[0] - lu[0])
                    fits = fits and (0 if least <= 0 else (min(z, ru[0]) - max(a, lu[0])) / least) <= 0.7
            if row and not fits:
                rows.append(row)
                row = []
            row.append(k)
        return [sorted(r, key=lambda k: centre(boxes[k])[0]) for r in [*rows, row]]

    start = sorted(range(len(boxes)), key=lambda k: centre(boxes[k])[1])
    wide = []
    for b in boxes:
        lu, ld, rd, ru = b["points"]
        if (ru[0] - lu[0] + rd[0] - ld[0]) / 2 > 250:
            wide.append(((ru[1] - lu[1]) / (ru[0] - lu[0]) + (rd[1] - ld[1]) / (rd[0] - ld[0])) / 2)
    first = sum(wide) / len(wide) if wide else 0
    tilted = sorted(start, key=lambda k: centre(boxes[k])[1] - centre(boxes[k])[0] * first)
    slopes = []
    for row in rows_at(first, start):
        if len(row) >= 4:
            x, y = zip(*[centre(boxes[k]) for k in row])
            mx, my = sum(x) / len(x), sum(y) / len(y)
            spread = sum((a - mx) ** 2 for a in x)
            slopes.append(sum((a - mx) * (b - my) for a, b in zip(x, y)) / spread if spread else x[0] * my / (x[0] ** 2 + 1))
    second = sum(slopes) / len(slopes) if slopes else 0
    return rows_at(first if abs(first) > abs(second) else second, tilted)


def test_ocr_rows_of_all_pages(spark, sf):
    found = {r["l_orderkey"]: (r["row_count"], r["text"]) for r in registry.QUERIES["ocr_rows"](spark, sf).collect()}
    for page in record_queries._pages(spark, sf).collect():
        rows = plain_rows(page["boxes"])
        assert found[page["l_orderkey"]] == (len(rows), "</n>".join(" ".join(page["boxes"][k]["text"] for k in row) for row in rows))


def test_merges_are_those_of_documents(spark, sf):
    words = Counter(w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for w in (r["text"] or "").split())
    vocab, expected = {w: (*w, "</w>") for w in words}, []
    for k in range(5):
        pairs = Counter()
        for w, n in words.items():
            for p in zip(vocab[w], vocab[w][1:]):
                pairs[p] += n
        left, right = min(pairs, key=lambda p: (-pairs[p], p))
        expected.append((k, left, right, pairs[left, right]))
        for w, s in vocab.items():
            out, at = [], 0
            while at < len(s):
                two = s[at : at + 2] == (left, right)
                out.append(left + right if two else s[at])
                at += 1 + two
            vocab[w] = tuple(out)
    found = registry.QUERIES["bpe_5_merges"](spark, sf).collect()
    assert [tuple(r) for r in sorted(found, key=lambda r: r["merge_no"])] == expected
