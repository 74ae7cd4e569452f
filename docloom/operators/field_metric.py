"""Field precision, recall and F1 of predicted documents, with greedy matching of list rows.

One sample is one row, so matching is a function of the row; counts are then summed by field with partial sums before
the only shuffle, and the total comes from the same aggregation by grouping sets.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def likeness(a: str, b: str) -> float:
    """2 * shared characters / all characters; 1 for two empty texts."""
    return _alike(Counter(a), len(a), Counter(b), len(b))


def _alike(a: Counter, n: int, b: Counter, m: int) -> float:
    return 2 * sum(min(k, b[c]) for c, k in a.items()) / (n + m) if n + m else 1.0


#: Gold rows of a list from which on they are searched in the order of their bounds, and those looked at together.
MANY, STRETCH = 32, 128


class _Ordered:
    """Texts by length. A text of n characters shares min(n, m) with one of m at most, so those of about its length come
    first, and the search ends where no longer or shorter one can be more alike than the best so far."""

    def __init__(self, texts: list[str]):
        by = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        self.places, self.lengths = np.array(by), np.array([len(texts[k]) for k in by])
        held = [Counter(texts[k]) for k in by]
        self.code: dict[str, int] = {}
        chars = [self.code.setdefault(c, len(self.code)) for h in held for c in h]
        self.chars, self.counts = np.array(chars, np.int64), np.array([n for h in held for n in h.values()], np.int64)
        self.ends = np.concatenate(([0], np.cumsum([len(h) for h in held])))

    def best(self, text: str, still: bytearray) -> int | None:
        """The place of the free text most alike, the last one of equals."""
        own, n, free = Counter(text), len(text), np.frombuffer(still, bool)
        wanted = np.zeros(len(self.code), np.int64)
        for c, k in own.items():
            if c in self.code:
                wanted[self.code[c]] = k
        bound = lambda m: 2 * min(n, m) / (n + m) if n + m else 1.0
        lo = hi = int(np.searchsorted(self.lengths, n))
        found, place = -1.0, None
        while lo > 0 or hi < len(self.lengths):
            shorter = bound(int(self.lengths[lo - 1])) if lo else -1.0
            longer = bound(int(self.lengths[hi])) if hi < len(self.lengths) else -1.0
            if max(shorter, longer) < found:
                break
            a, b = (max(0, lo - STRETCH), lo) if shorter > longer else (hi, min(len(self.lengths), hi + STRETCH))
            lo, hi = min(lo, a), max(hi, b)
            first, last = self.ends[a], self.ends[b]
            row = np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1]))
            shared = np.bincount(row, np.minimum(self.counts[first:last], wanted[self.chars[first:last]]), b - a)
            total = n + self.lengths[a:b]
            score = np.where(free[self.places[a:b]], np.where(total > 0, 2 * shared / np.maximum(total, 1), 1.0), -1.0)
            top = float(score.max())
            if top >= 0 and top >= found:
                at = int(self.places[a:b][score == top].max())
                place = at if top > found or place is None else max(place, at)
                found = top
        return place


class _Few:
    """A few texts. Those of the same characters are found by them, with no likeness worked out: none is more alike."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.same: dict[str, list[int]] = {}
        for k, t in enumerate(texts):
            self.same.setdefault("".join(sorted(t)), []).append(k)

    def best(self, text: str, still: bytearray) -> int | None:
        """The place of the free text most alike, the last one of equals."""
        for k in reversed(self.same.get("".join(sorted(text)), ())):
            if still[k]:
                return k
        n, found, place = len(text), -1.0, None
        chars = [(c, text.count(c)) for c in set(text)]
        for k, t in enumerate(self.texts):
            if still[k]:
                m = len(t)
                if 2 * min(n, m) / (n + m) >= found:  # two empty texts are of the same characters
                    shared = 0
                    for c, i in chars:
                        j = t.count(c)
                        shared += i if i < j else j
                    score = 2 * shared / (n + m)
                    if score >= found:
                        found, place = score, k
        return place


def _dicts(v: Any) -> bool:
    return isinstance(v, list) and all(isinstance(x, dict) for x in v)


def _text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def field_counts(pred: dict[str, Any], gold: dict[str, Any]) -> dict[str, list[int]]:
    """field -> [right, predicted, gold] of one sample, in the order of its keys (predicted ones first).

    A missing side of a list counts as as many empty rows. Rows match greedily: each predicted row takes the unused gold
    row most alike over its own keys, the last one of equals. A taken row is marked by value, so of equal gold rows only
    the first is ever marked.
    """
    out: dict[str, list[int]] = {}

    def rows(name: str, mine: list[dict], theirs: list[dict]) -> None:
        used: set[int] = set()
        free = bytearray(b"\1") * len(theirs)
        first: dict[int, int] = {}  # of a gold row the first that is equal to it
        known: dict[tuple, _Ordered | _Few] = {}  # gold rows over the keys of a predicted one
        cells: dict[str, list[int]] = {}

        def cell(c: str) -> list[int]:
            held = cells[c] = out.setdefault(f"{name}-{c}", [0, 0, 0])
            return held

        for row in mine:
            own = "-".join([v if type(v) is str else _text(v) for v in row.values()])
            keys = tuple(row)
            if keys not in known:
                texts = ["-".join([_text(x.get(c)) for c in keys]) for x in theirs]
                known[keys] = _Ordered(texts) if len(texts) > MANY else _Few(texts)
            best = known[keys].best(own, free)
            match = theirs[best] if best is not None and theirs[best] else None
            if match is not None:
                taken = first.setdefault(best, theirs.index(match) if best not in first else 0)
                used.add(taken)
                free[taken] = 0
            for c, v in row.items():
                held = cells.get(c) or cell(c)
                held[1] += 1
                if match is not None:
                    held[2] += 1
                    if v == match.get(c):
                        held[0] += 1
        for k, row in enumerate(theirs):
            if k not in used:
                for c in row:
                    (cells.get(c) or cell(c))[2] += 1

    for key in dict.fromkeys([*pred, *gold]):
        p, g = pred.get(key), gold.get(key)
        if isinstance(g, list) and not p:
            p = [dict.fromkeys(x) for x in g if isinstance(x, dict)] if _dicts(g) else p
        if isinstance(p, list) and not g:
            g = [dict.fromkeys(x) for x in p if isinstance(x, dict)] if _dicts(p) else g
        if _dicts(p) and _dicts(g):
            rows(key, p, g)
        else:
            held = out.setdefault(key, [0, 0, 0])
            held[1], held[2] = int(p is not None), int(g is not None)
            if p == g:
                held[0] = int(p is not None)
    return out


_COUNTS = "field string, field_order int, right_num bigint, pred_num bigint, gt_num bigint"


def _read(text: Any) -> dict[str, Any]:
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return {}
    return value if isinstance(value, dict) else {}


def summed_counts(samples: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """A row for each field of each batch of samples: sums, and the field's least place. Documents are JSON objects; null
    or unreadable ones count as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, list[int]] = {}
            for p, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, (name, n) in enumerate(field_counts(_read(p), _read(g)).items()):
                    held = sums.setdefault(name, [k, 0, 0, 0])
                    held[:] = min(held[0], k), held[1] + n[0], held[2] + n[1], held[3] + n[2]
            columns = [pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.int32())]
            columns += [pa.array([v[c] for v in sums.values()], pa.int64()) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(columns, ["field", "field_order", "right_num", "pred_num", "gt_num"])

    return samples.select(F.col(pred).alias("pred"), F.col(gold).alias("gold")).mapInArrow(each, _COUNTS)


def flat_counts(samples: DataFrame, by: str, pred: str, gold: str) -> DataFrame:
    """The same for documents of scalars only, as maps, by joining their fields: native."""
    side = lambda c, v: samples.select(by, F.posexplode(F.map_entries(c)).alias("at", "e")).select(by, F.col("e.key").alias("field"), F.col("e.value").alias(v), F.col("at").alias(f"{v}_at"))
    met = side(pred, "p").join(side(gold, "g"), [by, "field"], "full_outer")
    there = lambda c: F.col(c).isNotNull().cast("bigint")
    return met.select(by, "field", F.coalesce("p_at", F.col("g_at") + 1000).cast("int").alias("field_order"), F.coalesce((F.col("p") == F.col("g")).cast("bigint"), F.lit(0)).alias("right_num"), there("p").alias("pred_num"), there("g").alias("gt_num"))


def scores(counts: DataFrame) -> DataFrame:
    """field, field_order, right_num, pred_num, gt_num, precision, recall, f1; and a row "total".

    Fields: smoothed ratios rounded to 4 places, F1 from the rounded ones. Total: plain ratios, null where a sum is 0.
    """
    sums = counts.groupingSets([["field"], []], "field").agg(*[F.sum(c).alias(c) for c in ("right_num", "pred_num", "gt_num")], F.min("field_order").alias("field_order"), F.grouping("field").alias("all_"))
    r, p, g = F.col("right_num"), F.col("pred_num"), F.col("gt_num")
    smooth = lambda n: F.round(r / (n + 1e-6), 4)
    f1 = lambda a, b, e: F.round(F.try_divide(2 * a * b, a + b + e), 4)
    a, b = F.try_divide(r, p), F.try_divide(r, g)
    total = F.col("all_") == 1
    return sums.filter(~total | p.isNotNull()).select(
        F.when(total, F.lit("total")).otherwise(F.col("field")).alias("field"),
        F.when(total, F.lit(2147483647)).otherwise(F.col("field_order")).alias("field_order"),
        "right_num", "pred_num", "gt_num",
        F.when(total, F.round(a, 4)).otherwise(smooth(p)).alias("precision"),
        F.when(total, F.round(b, 4)).otherwise(smooth(g)).alias("recall"),
        F.when(total, f1(a, b, F.lit(0.0))).otherwise(f1(smooth(p), smooth(g), F.lit(1e-6))).alias("f1"),
    )


def field_f1(samples: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """The scores of samples with JSON documents."""
    return scores(summed_counts(samples, pred, gold))


def flattened(value: dict[str, Any], path: str = "") -> list[tuple[str, Any]]:
    """(path, leaf) of nested lists of dicts: path-number-key."""
    out: list[tuple[str, Any]] = []
    for k, v in value.items():
        name = f"{path}-{k}" if path else k
        if _dicts(v):
            for n, x in enumerate(v):
                out += flattened(x, f"{name}-{n}")
        else:
            out.append((name, v))
    return out


def mean_similarity(similarity: Column) -> Column:
    return F.avg(similarity)
