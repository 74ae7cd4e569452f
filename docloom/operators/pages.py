"""Pages of recognised boxes into rows of text.

A page is one row with its boxes in an array, so grouping boxes into rows needs no shuffle: it is a function of the
array. It is a greedy scan with running means, hence Arrow-batched Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: How far a box may be off its row (pixels without a height, else shares of it), and how much overlap in
#: x makes a new row; boxes wider than WIDE and rows of ROW_BOXES or more tell the page's slope.
OFF_PIXELS, OFF_SHARE, OVERLAP, WIDE, ROW_BOXES = 12, 0.7, 0.7, 250, 4
_WORD = re.compile(r"\w")


@dataclass
class Box:
    text: str
    points: list[list[float]]
    place: int
    corners: list[list[float]] = field(default_factory=list)
    x: float = 0.0
    y: float = 0.0
    bias: float = 0.0


def _ordered(points: list[list[float]], x: float) -> list[list[float]]:
    return sorted((p for p in points if p[0] <= x), key=lambda p: p[1]) + sorted((p for p in points if p[0] > x), key=lambda p: -p[1])


def _slope(boxes: list[Box]) -> float:
    found = []
    for b in boxes:
        lu, ld, rd, ru = b.corners
        up, down = ru[0] - lu[0], rd[0] - ld[0]
        if (up + down) / 2 > WIDE and up and down:
            found.append(((ru[1] - lu[1]) / up + (rd[1] - ld[1]) / down) / 2)
    return sum(found) / len(found) if found else 0.0


def _row_slope(rows: list[list[Box]]) -> float:
    found = []
    for row in rows:
        if len(row) >= ROW_BOXES:
            x, y = np.array([b.x for b in row]), np.array([b.y for b in row])
            spread = np.square(x - x.mean()).sum()
            found.append(float(((x - x.mean()) * (y - y.mean())).sum() / spread) if spread > 0 else float(x[0] * y.mean() / (x[0] ** 2 + 1)))
    return sum(found) / len(found) if found else 0.0


def _scan(boxes: list[Box]) -> list[list[Box]]:
    """Boxes sorted by bias into rows: a box joins the open row if it is near its mean and beside its boxes."""
    rows: list[list[Box]] = []
    row: list[Box] = []
    mean, heights = -float(OFF_PIXELS), []
    for b in boxes:
        height = sum(heights) / len(heights) if heights else 0.0
        off = abs(b.bias - mean)
        near = off / height <= OFF_SHARE if height > 0 else off < OFF_PIXELS
        widths = [(b.corners[0][0], b.corners[3][0], a.corners[0][0], a.corners[3][0]) for a in row]
        over = [(min(e1, e2) - max(b1, b2)) / least if (least := min(e1 - b1, e2 - b2)) > 0 else 0.0 for b1, e1, b2, e2 in widths]
        if not (near and max(over, default=-10.0) <= OVERLAP):
            if row:
                rows.append(row)
            row, heights = [], []
        row.append(b)
        mean = sum(a.bias for a in row) / len(row)
        if _WORD.search(b.text):
            heights.append(abs(b.corners[0][1] - b.corners[1][1]))
    rows.append(row)
    return [sorted(r, key=lambda b: b.x) for r in rows]


def text_rows(boxes: list[tuple[str, list[list[float]]]], fixed: bool = False) -> list[list[int]]:
    """Rows of places of (text, points) boxes. Corners are the points as stored (LU, LD, RD, RU), or ordered if fixed.

    An empty page is one empty row.
    """
    page = [Box(text or "", points, k) for k, (text, points) in enumerate(boxes)]
    for b in page:
        b.x, b.y = (sum(p[k] for p in b.points) / len(b.points) for k in (0, 1))
        b.corners = _ordered(b.points, b.x) if fixed else b.points
        if len(b.corners) != 4:
            raise ValueError("a box has four points")
    page.sort(key=lambda b: b.y)

    def rows_at(slope: float) -> list[list[Box]]:
        for b in page:
            b.bias = b.y - b.x * slope
        page.sort(key=lambda b: b.bias)
        return _scan(page)

    first = _slope(page)
    second = _row_slope(rows_at(first))
    return [[b.place for b in row] for row in rows_at(first if abs(first) > abs(second) else second)]


def _boxes(held: pa.ListArray) -> Iterator[list[tuple[str, list[list[float]]]]]:
    """The (text, points) boxes of each page, from flat arrays where every box has four points of two numbers."""
    flat = held.flatten()
    texts, points = flat.field("text").to_pylist(), flat.field("points")
    inner = points.flatten()
    values = inner.flatten()
    if len(inner) == 4 * len(flat) and len(values) == 8 * len(flat) and not (points.null_count or inner.null_count or values.null_count):
        corners = values.to_numpy().reshape(-1, 4, 2).tolist()
    else:
        corners = points.to_pylist()
    end = 0
    for n in pc.fill_null(pc.list_value_length(held), 0).to_pylist():
        yield list(zip(texts[end : end + n], corners[end : end + n]))
        end += n


def page_rows(pages: DataFrame, boxes: str = "boxes", fixed: bool = False) -> DataFrame:
    """pages with page_rows: array of arrays of places (from 0) in boxes (array of struct with text and points).

    A page without boxes, or null ones, is one empty row.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.array([text_rows(page, fixed) for page in _boxes(b.column(boxes))], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns, rows], [*b.schema.names, "page_rows"])

    from pyspark.sql import types as T

    return pages.mapInArrow(each, T.StructType([*pages.schema.fields, T.StructField("page_rows", T.ArrayType(T.ArrayType(T.IntegerType())))]))
