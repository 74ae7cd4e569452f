"""Box geometry on arrays: points is an array of four [x, y] arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def centre(points: Column) -> Column:
    """struct(x, y): the mean of the four points."""
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(points)
    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


def ordered_corners(points: Column) -> Column:
    """Left points from top to bottom, then right points from bottom to top."""
    cx = centre(points)["x"]
    left = F.filter(F.transform(points, lambda p, i: F.struct(p[1].alias("k"), i.alias("i"), p.alias("p"))), lambda s: s["p"][0] <= cx)
    right = F.filter(F.transform(points, lambda p, i: F.struct((-p[1]).alias("k"), i.alias("i"), p.alias("p"))), lambda s: s["p"][0] > cx)
    return F.transform(F.concat(F.array_sort(left), F.array_sort(right)), lambda s: s["p"])


def extent(boxes: Column) -> Column:
    """struct(w, h): the largest x and y of any point of a page's boxes."""
    most = lambda k: F.array_max(F.transform(F.flatten(F.transform(boxes, lambda b: b["points"])), lambda p: p[k]))
    return F.struct(most(0).alias("w"), most(1).alias("h"))


def cross_rate(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Overlap of two intervals over the shorter; 0 if the shorter is empty."""
    shorter = F.least(e1 - b1, e2 - b2)
    return F.when(shorter <= 0, F.lit(0.0)).otherwise((F.least(e1, e2) - F.greatest(b1, b2)) / shorter)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two rectangles (x1, y1, x2, y2) meet; touching counts."""
    return ~((a["x2"] < b["x1"]) | (a["x1"] > b["x2"]) | (a["y2"] < b["y1"]) | (a["y1"] > b["y2"]))


def box_slope(points: Column, least_width: float = 250) -> Column:
    """Mean of the upper and lower edge's slope of a box wider than least_width, else null. Corners: LU, LD, RD, RU."""
    lu, ld, rd, ru = (points[k] for k in range(4))
    up, down = ru[0] - lu[0], rd[0] - ld[0]
    return F.when((up + down) / 2 > least_width, (F.try_divide(ru[1] - lu[1], up) + F.try_divide(rd[1] - ld[1], down)) / 2)


def opposite(points: Column) -> Column:
    """The first and third point."""
    return F.array(points[0], points[2])


def char_spans(points: Column, mids: Column) -> Column:
    """array of struct(left, right): x-bounds of characters around their middles, inside the box."""
    left_edge = (points[0][0] + points[1][0]) / 2
    right_edge = (points[3][0] + points[2][0]) / 2
    n = F.size(mids)

    def span(m: Column, i: Column) -> Column:
        before = F.when(i > 0, (m - F.get(mids, i - 1)) / 2).otherwise(m - left_edge)
        after = F.when(i < n - 1, (F.get(mids, i + 1) - m) / 2).otherwise(right_edge - m)
        half = F.least(F.abs(before), F.abs(after))
        a, b = F.greatest(m - half, left_edge), F.least(m + half, right_edge)
        thin = b - a < 0.1
        return F.struct(F.when(thin, F.lit(0.1)).otherwise(a).alias("left"), F.when(thin, F.lit(0.1)).otherwise(b).alias("right"))

    return F.transform(mids, span)


def char_boxes(points: Column, mids: Column) -> Column:
    """Four points for each character. The upper edge is measured against the lower right corner, as the data's
    producer does; a box without width gives nulls."""
    lu, ld, rd, ru = (points[k] for k in range(4))
    up = lambda x: F.try_divide((ru[1] - lu[1]) * (x - lu[0]), rd[0] - lu[0]) + lu[1]
    down = lambda x: F.try_divide((rd[1] - ld[1]) * (x - ld[0]), rd[0] - ld[0]) + ld[1]
    return F.transform(char_spans(points, mids), lambda s: F.array(F.array(s["left"], up(s["left"])), F.array(s["left"], down(s["left"])), F.array(s["right"], down(s["right"])), F.array(s["right"], up(s["right"]))))


def reading_order(rows: Column) -> Column:
    """Boxes of all rows, without those of empty text."""
    return F.filter(F.flatten(rows), lambda b: b["text"] != "")
