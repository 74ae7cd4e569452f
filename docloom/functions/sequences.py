"""Token sequences in arrays: masks, shifts, padding, positions and spans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IGNORED = -100


def tokens(text: Column) -> Column:
    """Tokens between blanks, as a stand-in for a tokenizer's ids."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def label_mask(ids: Column, separator: Column | int, ignored: int = IGNORED) -> Column:
    """Everything up to and with the first separator becomes `ignored`; without a separator the row is null."""
    at = F.array_position(ids, separator).cast("int")
    return F.when(at > 0, F.concat(F.array_repeat(F.lit(ignored), at), F.slice(ids, at + 1, F.greatest(F.size(ids) - at, F.lit(0)))))


def label_mask_shifted(ids: Column, separator: Column | int, ignored: int = IGNORED) -> Column:
    """Labels one token on, those before the separator ignored, the separator kept."""
    moved = F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))
    at = F.array_position(moved, separator).cast("int")
    return F.when(at > 0, F.concat(F.array_repeat(F.lit(ignored), at - 1), F.slice(moved, F.greatest(at, F.lit(1)), F.size(moved) - at + 1)))


def next_tokens(ids: Column) -> Column:
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))


def shifted_right(ids: Column, start: int) -> Column:
    """Decoder input: a start token, then all but the last token."""
    return F.concat(F.array(F.lit(start)), F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))))


def decoder_input(ids: Column, eos: int, pad: int) -> Column:
    """All but the last token, end tokens replaced by padding."""
    return F.transform(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), lambda x: F.when(x == eos, F.lit(pad)).otherwise(x))


def rounded_length(length: Column, multiple: int) -> Column:
    return (F.ceil(length / multiple) * multiple).cast("int")


def left_padded(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)).cast("int")), ids)


def attention_mask(ids: Column, length: Column) -> Column:
    """0 for left padding, 1 for tokens."""
    return F.concat(F.array_repeat(F.lit(0), F.greatest(length - F.size(ids), F.lit(0)).cast("int")), F.transform(ids, lambda x: F.lit(1)))


def position_ids(ids: Column, length: Column) -> Column:
    """0 over left padding, then 0, 1, 2, ..."""
    return F.concat(F.array_repeat(F.lit(0), F.greatest(length - F.size(ids), F.lit(0)).cast("int")), F.transform(ids, lambda x, i: i))


def causal_mask(n: Column) -> Column:
    """n rows of n: 1 where the column is not after the row."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: (j <= i).cast("int")))


def special_tokens_mask(ids: Column) -> Column:
    """1 for the begin and end tokens around ids."""
    return F.concat(F.array(F.lit(1)), F.transform(ids, lambda x: F.lit(0)), F.array(F.lit(1)))


def with_specials(ids: Column, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def spans(ids: Column, start: Column | int, end: Column | int) -> Column:
    """(first, last) of the i-th start mark and the i-th end mark: one past the start, and the end itself."""
    at = lambda mark: F.filter(F.transform(ids, lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull())
    a, b = at(start), at(end)
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct((x + 1).alias("first"), y.alias("last")))


def spliced(ids: Column, at: Column, length: int, features: Column) -> Column:
    """ids with the `length` tokens from index `at` (from 0) replaced by features."""
    return F.concat(F.slice(ids, F.lit(1), at), features, F.slice(ids, at + length + 1, F.greatest(F.size(ids) - at - length, F.lit(0))))


def spliced_positions(n: Column, at: Column, length: int, features: Column) -> Column:
    """Positions after splicing: the middle position of the replaced tokens stands for all features but the outer two."""
    plain = F.sequence(F.lit(0), n - 1)
    middle = F.array_repeat(at + 1, (features - 2).cast("int"))
    return F.concat(F.slice(plain, F.lit(1), at + 1), middle, F.slice(plain, at + length, F.greatest(n - at - length + 1, F.lit(0))))


def vision_expert(types: Column, vision: int = 1) -> Column:
    """True where a token and the next one are vision tokens; the last is not."""
    after = F.concat(F.slice(types, 2, F.greatest(F.size(types) - 1, F.lit(0))), F.array(F.lit(0)))
    return F.zip_with(types, after, lambda a, b: (a == vision) & (b == vision))


def grid_positions(t: Column, h: Column, w: Column, start: Column) -> Column:
    """(t, h, w) positions of a vision run, row by row from start."""
    n = F.sequence(F.lit(0), t * h * w - 1)
    return F.transform(n, lambda i: F.struct((start + F.floor(i / (h * w))).cast("int").alias("t"), (start + F.floor(i / w) % h).cast("int").alias("h"), (start + i % w).cast("int").alias("w")))


def text_positions(n: Column, start: Column) -> Column:
    """(t, h, w) positions of n text tokens: all axes advance together."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((start + i).cast("int").alias("t"), (start + i).cast("int").alias("h"), (start + i).cast("int").alias("w")))).otherwise(F.array().cast("array<struct<t:int,h:int,w:int>>"))


def merged_ids(h: Column, w: Column, merge: int = 2) -> Column:
    """(h, w) of patches in the order of merge blocks: blocks row by row, patches row by row inside a block."""
    n = F.sequence(F.lit(0), h * w - 1)
    m2 = merge * merge

    def place(i: Column) -> Column:
        block, inner = F.floor(i / m2), i % m2
        across = F.floor(w / merge)
        return F.struct((F.floor(block / across) * merge + F.floor(inner / merge)).cast("int").alias("h"), (block % across * merge + inner % merge).cast("int").alias("w"))

    return F.transform(n, place)


def vision_pads(size: int, patch: int) -> int:
    """Placeholders for a square image: patches halved either way, and two marks."""
    return (size // patch // 2) ** 2 + 2
