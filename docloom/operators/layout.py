"""Layouts that are made step by step: images set on canvases, labels beside boxes.

Each step depends on those before it, so a group is one stream in its order. Rows are dealt out by group and sorted, and
a task goes through them with a state: a place on a canvas, or the labels of a page so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: The gaps between images, least and most; the lines of boxes, and the room that a label leaves for them.
GAPS = (2, 5)
BEFORE, AFTER = 2, 3


def stepped(rows: DataFrame, by: list[str], order: list[str], reads: list[str], out: T.StructType, start: Callable[[], Any], step: Callable[..., tuple | None]) -> DataFrame:
    """rows with the columns of out, which step(state, *reads) gives for each row in order; state: one start() a group."""
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for b in batches:
            made = []
            for own, values in zip(zip(*(b.column(c).to_pylist() for c in by)), zip(*(b.column(c).to_pylist() for c in reads))):
                if state is None or own != group:
                    group, state = own, start()
                made.append(step(state, *values) or (None,) * len(out))
            columns = [pa.array(c, t.type) for c, t in zip(zip(*made), arrow_out)] if made else [pa.array([], t.type) for t in arrow_out]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *out.names])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_out = to_arrow_schema(out)
    return dealt.mapInArrow(each, T.StructType([*dealt.schema.fields, *out.fields]))


def drawn_gap(seed: int, axis: str, *key: str, gaps: tuple[int, int] = GAPS) -> Column:
    """A gap between the least and the most, drawn by a hash of seed, axis and key."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), *key), F.lit(gaps[1] - gaps[0] + 1)) + gaps[0]).cast("int")


class _Sheet:
    """Where the next image goes: the canvas, the place in it, and the height of the row so far."""

    def __init__(self) -> None:
        self.number, self.x, self.y, self.tall = 0, 0, 0, 0


def on_canvases(images: DataFrame, by: str, order: list[str], width: str, height: str, canvas: tuple[int, int] = (1280, 1280), seed: int = 0, gap_x: Column | None = None, gap_y: Column | None = None) -> DataFrame:
    """images with sheet, left_x and top_y: each group's images set from left to right in rows, rows from top to bottom.

    A gap is drawn for each image and axis (or given) and counts when it is asked whether the image fits. An image that
    does not fit into a row starts the next; if that does not fit, a canvas. One too tall for a canvas is left out (nulls),
    but its canvas stays begun; one wider than a canvas stands in a row of its own. Images without a size are left out.
    """
    wide, high = canvas
    sheet = T.StructType([T.StructField(n, T.IntegerType()) for n in ("sheet", "left_x", "top_y")])

    def step(at: _Sheet, w: int | None, h: int | None, gx: int, gy: int) -> tuple | None:
        if w is None or h is None:
            return None
        if at.x + w + gx > wide:
            at.x, at.y, at.tall = 0, at.y + at.tall + gy, 0
            if at.y + h + gy > high:
                at.number, at.y = at.number + 1, 0
        if at.y + h + gy > high:
            return None
        place = at.number, at.x, at.y
        at.x, at.tall = at.x + w + gx, max(at.tall, h)
        return place

    rows = images.withColumns({"gap_x_": gap_x if gap_x is not None else drawn_gap(seed, "x", by, *order), "gap_y_": gap_y if gap_y is not None else drawn_gap(seed, "y", by, *order)})
    return stepped(rows, [by], order, [width, height, "gap_x_", "gap_y_"], sheet, _Sheet, step).drop("gap_x_", "gap_y_")


def placed_labels(boxes: DataFrame, by: str, order: list[str], x: str, y: str, width: str, page_height: str, height: int) -> DataFrame:
    """boxes with label, struct(x1, y1, x2, y2): a label of that width and height above each box's upper left corner.

    Where the page's edge leaves no room the label stands below the corner, inside the box. It then moves down by its
    height for each label placed before it on the page that it meets, in their order; at the page's lower border it stops
    moving for that one. The steps past a label are counted at
    once. A page's labels are held while it is gone through. Boxes without a corner, width or page get null.
    """
    label = T.StructType([T.StructField("label", T.StructType([T.StructField(n, T.IntegerType()) for n in ("x1", "y1", "x2", "y2")]))])

    def step(before: list, bx: int | None, by_: int | None, w: int | None, page: int | None) -> tuple | None:
        if None in (bx, by_, w, page):
            return None
        left, low = bx - BEFORE, by_ - BEFORE
        if low < height:
            left, low = bx + AFTER, by_ + AFTER + height
        top = low - height
        for x1, y1, x2, y2 in before:
            if left + w < x1 or left > x2 or low < y1 or top > y2:
                continue
            clear = (y2 - top) // height + 1  # steps until it stands below that label
            border = max(1, -(-(page - low) // height))  # steps until it reaches the border
            if border <= clear:
                top, low = max(0, page - height), page
            else:
                top, low = top + clear * height, low + clear * height
        before.append((left, top, left + w, low))
        return ({"x1": left, "y1": top, "x2": left + w, "y2": low},)

    return stepped(boxes, [by], order, [x, y, width, page_height], label, list, step)
