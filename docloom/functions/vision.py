"""Arithmetic on image and video sizes: resizing, tiles, slices, frames, position embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def smart_resize(height: Column, width: Column, factor: int = 28, least: int = 56 * 56, most: int = 14 * 14 * 4 * 1280) -> Column:
    """struct(h, w): both sides multiples of factor, the area within bounds; null for sides below factor or ratios over 200."""
    f = float(factor)
    h0, w0 = F.bround(height / f) * f, F.bround(width / f) * f
    beta = F.sqrt(height * width / F.when(h0 * w0 > most, F.lit(float(most))).otherwise(F.lit(float(least))))
    up = F.sqrt(F.lit(float(least)) / (height * width))
    h = F.when(h0 * w0 > most, F.floor(height / beta / f).cast("double") * f).when(h0 * w0 < least, F.ceil(height * up / f).cast("double") * f).otherwise(h0)
    w = F.when(h0 * w0 > most, F.floor(width / beta / f).cast("double") * f).when(h0 * w0 < least, F.ceil(width * up / f).cast("double") * f).otherwise(w0)
    ok = (F.least(height, width) >= factor) & (F.greatest(height, width) / F.least(height, width) <= 200)
    return F.when(ok, F.struct(h.cast("int").alias("h"), w.cast("int").alias("w")))


def patch_grid(height: Column, width: Column, frames: Column, patch: int = 14, temporal: int = 2) -> Column:
    """struct(t, h, w) of patches; a single image is doubled in time."""
    t = F.greatest(F.floor(frames / temporal), F.lit(1))
    return F.struct(t.cast("int").alias("t"), F.floor(height / patch).cast("int").alias("h"), F.floor(width / patch).cast("int").alias("w"))


def ratios(least: int = 1, most: int = 12) -> list[tuple[int, int]]:
    """Grids (across, down) of least to most tiles, by tiles, then across, then down."""
    return sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most), key=lambda r: (r[0] * r[1], r[0], r[1]))


def closest_grid(width: Column, height: Column, least: int = 1, most: int = 12, size: int = 448) -> Column:
    """struct(across, down): the grid of nearest aspect; ties go on to a larger grid if the image is large enough for it."""
    grids = F.array(*[F.struct(F.lit(i).alias("across"), F.lit(j).alias("down")) for i, j in ratios(least, most)])
    aspect, area = width / height, width * height

    def step(best: Column, g: Column) -> Column:
        off = F.abs(aspect - g["across"] / g["down"])
        taken = F.struct(off.alias("off"), g["across"].alias("across"), g["down"].alias("down"))
        larger = (off == best["off"]) & (area > 0.5 * size * size * g["across"] * g["down"])
        return F.when((off < best["off"]) | larger, taken).otherwise(best)

    first = F.struct(F.lit(float("inf")).alias("off"), F.lit(1).alias("across"), F.lit(1).alias("down"))
    return F.aggregate(grids, first, step, lambda b: F.struct(b["across"].alias("across"), b["down"].alias("down")))


def tile_boxes(grid: Column, size: int = 448, thumbnail: bool = True) -> Column:
    """Crop boxes (left, top, right, bottom) row by row, and the whole square as a thumbnail if there are several."""
    n = grid["across"] * grid["down"]
    box = lambda i: F.struct(*[(v * size).cast("int").alias(k) for k, v in (("left", i % grid["across"]), ("top", F.floor(i / grid["across"])), ("right", i % grid["across"] + 1), ("bottom", F.floor(i / grid["across"]) + 1))])
    tiles = F.transform(F.sequence(F.lit(0), n - 1), box)
    if not thumbnail:
        return tiles
    whole = F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(size).alias("right"), F.lit(size).alias("bottom")))
    return F.when(n > 1, F.concat(tiles, whole)).otherwise(tiles)


def frame_indices(last: Column, fps: Column, segments: int, bound: tuple[float, float] | None = None, first: int = 0) -> Column:
    """Indices of frames in the middle of equal segments, between bounds in seconds, from frame `first`."""
    begin, end = bound or (-100000.0, 100000.0)
    start = F.greatest(F.lit(float(first)), F.bround(F.lit(begin) * fps))
    stop = F.least(F.bround(F.lit(end) * fps), last.cast("double"))
    seg = (stop - start) / segments
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: (start + seg / 2 + F.bround(seg * i)).cast("int"))


def slice_grid(width: Column, height: Column, most: int = 9, size: int = 448) -> Column:
    """struct(across, down) of slices, nearest in log aspect among grids of about area / size^2 cells; null for one cell."""
    ideal = F.least(F.ceil(width * height / float(size * size)), F.lit(most)).cast("int")
    log = F.log(width / height)
    pairs = F.array(*[F.struct(F.lit(m * n).alias("cells"), F.lit(m).alias("across"), F.lit(n).alias("down"), F.lit(math.log(m / n)).alias("log")) for k in range(2, most + 1) for m in range(1, k + 1) if k % m == 0 for n in [k // m]])
    near = F.filter(pairs, lambda p: F.abs(p["cells"] - ideal) <= 1)
    ranked = F.transform(near, lambda p, i: F.struct(F.abs(log - p["log"]).alias("off"), i.alias("i"), p["across"].alias("across"), p["down"].alias("down")))
    best = F.array_min(ranked)
    return F.when(ideal > 1, F.struct(best["across"].alias("across"), best["down"].alias("down")))


def ensure_divide(length: Column, patch: int = 14) -> Column:
    return F.greatest(F.bround(length / float(patch)) * patch, F.lit(float(patch))).cast("int")


def best_resize(width: Column, height: Column, size: int = 448, patch: int = 14, upscale: bool = False) -> Column:
    """struct(w, h): the area of size^2 at most (or exactly, with upscale), sides multiples of patch."""
    ratio = width / height
    over = (width * height > size * size) | F.lit(upscale)
    h = F.when(over, F.floor(size / F.sqrt(ratio)).cast("double")).otherwise(height.cast("double"))
    w = F.when(over, F.floor(h * ratio).cast("double")).otherwise(width.cast("double"))
    return F.struct(ensure_divide(w, patch).alias("w"), ensure_divide(h, patch).alias("h"))


def refined_size(width: Column, height: Column, grid: Column, size: int = 448, patch: int = 14) -> Column:
    """struct(w, h): the size whose grid cells are each resized best."""
    fit = lambda x, n: F.greatest(F.bround(x / n.cast("double")) * n, n.cast("double"))
    w, h = fit(width, grid["across"]), fit(height, grid["down"])
    best = best_resize(w / grid["across"], h / grid["down"], size, patch, True)
    return F.struct((best["w"] * grid["across"]).alias("w"), (best["h"] * grid["down"]).alias("h"))


def sincos_1d(position: Column, dim: int) -> Column:
    """Sines, then cosines, of position over dim / 2 wavelengths."""
    omega = [1.0 / 10000 ** (i / (dim / 2)) for i in range(dim // 2)]
    return F.concat(F.array(*[F.sin(position * w) for w in omega]), F.array(*[F.cos(position * w) for w in omega]))


def sincos_2d(row: Column, column: Column, dim: int) -> Column:
    """Half of the dimensions for the column, half for the row."""
    return F.concat(sincos_1d(column, dim // 2), sincos_1d(row, dim // 2))


def shuffled_index(n: Column, w: Column, c: Column, scale: int = 2) -> Column:
    """Where the flat value n of a (h, w, c) grid goes when scale x scale neighbours fold into channels, as (h, w, c)."""
    ch, col, row = n % c, F.floor(n / c) % w, F.floor(F.floor(n / c) / w)
    return F.struct(F.floor(row / scale).cast("int").alias("h"), F.floor(col / scale).cast("int").alias("w"), ((row % scale * scale + col % scale) * c + ch).cast("int").alias("c"))


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of the image as whole pixels, cut towards zero."""
    return F.struct(*[(box[k] * s).cast("int").alias(k) for k, s in (("x1", width), ("y1", height), ("x2", width), ("y2", height))])
