"""Canvas packing and label placement against plain code."""

import random
from collections import Counter

from docloom.operators import layout
from docloom.plans import record_queries, registry  # noqa: F401


def plain_canvases(images, canvas):
    """(key, sheet, x, y) or (key, None, None, None) for (key, w, h, gap x, gap y)."""
    out, sheet, x, y, tall = [], 0, 0, 0, 0
    for key, w, h, gx, gy in images:
        if x + w + gx > canvas[0]:
            x, y, tall = 0, y + tall + gy, 0
            if y + h + gy > canvas[1]:
                sheet, y = sheet + 1, 0
        if y + h + gy > canvas[1]:
            out.append((key, None, None, None))
            continue
        out.append((key, sheet, x, y))
        x, tall = x + w + gx, max(tall, h)
    return out


def plain_labels(boxes, height):
    """Each label moved down step by step while it meets one placed before; (x, y, width, page height)."""
    done = []
    for x, y, w, page in boxes:
        left, low = (x - 2, y - 2) if y - 2 >= height else (x + 3, y + 3 + height)
        own = [left, low - height, left + w, low]
        for d in done:
            while not (own[2] < d[0] or own[0] > d[2] or own[3] < d[1] or own[1] > d[3]):
                own[1], own[3] = own[1] + height, own[3] + height
                if own[3] >= page:
                    own[1], own[3] = max(0, page - height), page
                    break
        done.append(tuple(own))
    return done


def test_canvases_of_groups(spark):
    rnd = random.Random(1)
    rows = [(g, k, rnd.randint(1, 70), rnd.randint(1, 55)) for g in (None, "a", "b") for k in range(120)]
    df = spark.createDataFrame(rows, "g string, k int, w int, h int").withColumn("sheet_", layout.F.lit(1))
    drawn = df.select("*", layout.drawn_gap(5, "x", "g", "k").alias("gx"), layout.drawn_gap(5, "y", "g", "k").alias("gy"))
    gaps = {(r["g"], r["k"]): (r["gx"], r["gy"]) for r in drawn.collect()}
    assert {v for xy in gaps.values() for v in xy} == {2, 3, 4, 5}
    found = {(r["g"], r["k"]): (r["sheet"], r["left_x"], r["top_y"]) for r in layout.on_canvases(df, "g", ["k"], "w", "h", (64, 48), seed=5).collect()}
    for g in (None, "a", "b"):
        for (own, *place) in plain_canvases([((g, k), w, h, *gaps[g, k]) for gg, k, w, h in rows if gg == g], (64, 48)):
            assert found[own] == tuple(place)
    assert any(v[0] is None for v in found.values()) and max(v[0] or 0 for v in found.values()) > 3
    empty = spark.createDataFrame([("a", 1, None, 3)], "g string, k int, w int, h int")
    assert layout.on_canvases(empty, "g", ["k"], "w", "h").first()["sheet"] is None
    assert layout.on_canvases(empty.limit(0), "g", ["k"], "w", "h").count() == 0


def test_labels_of_pages(spark, sf):
    rnd = random.Random(2)
    rows = [(g, k, rnd.randint(0, 60), rnd.randint(0, 120), rnd.randint(5, 60), 130) for g in range(6) for k in range(25)]
    df = spark.createDataFrame(rows, "g int, k int, x int, y int, w int, p int")
    found = {(r["g"], r["k"]): tuple(r["label"]) for r in layout.placed_labels(df, "g", ["k"], "x", "y", "w", "p", 9).collect()}
    for g in range(6):
        assert [found[g, k] for k in range(25)] == plain_labels([r[2:] for r in rows if r[0] == g], 9)
    none = layout.placed_labels(df.withColumn("w", layout.F.lit(None).cast("int")), "g", ["k"], "x", "y", "w", "p", 9)
    assert none.filter("label IS NULL").count() == len(rows)


def test_label_places_of_the_table(spark, sf):
    found = Counter(tuple(r) for r in registry.QUERIES["label_places"](spark, sf).collect())
    pages, wanted, moved = {}, Counter(), 0
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        n, q = r["l_linenumber"], int(r["l_quantity"])
        pages.setdefault(r["l_orderkey"], []).append((n, (n % 3 * 20 + q, n * 7 + q % 9, 40 + q, 60 + r["l_orderkey"] % 50)))
    for page, boxes in pages.items():
        boxes.sort()
        placed = plain_labels([b for _, b in boxes], 14)
        wanted.update((page, n, *p) for (n, _), p in zip(boxes, placed))
        moved += sum(p != plain_labels([b], 14)[0] for p, (_, b) in zip(placed, boxes))
    assert found == wanted and moved > found.total() / 10
