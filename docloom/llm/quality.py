"""Quality scores by random Fourier features over document statistics.

Every whole text gives a row of statistics (lengths, kinds of characters, repetition). Cosines of random projections of
the standardised statistics approximate a Gaussian kernel; ridge regression on them is fitted from normal equations
that each partition sums over its labelled rows; SUMS tasks add those of all partitions, so the driver gets a few
matrices of a fixed size, whatever the number of labels. Scores become probabilities by isotonic regression over a fixed number of bins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import scratch, staged

#: Fourier features, kernel width in standard deviations a statistic, ridge a row, tasks that add up sums, bins.
WIDTH, BANDWIDTH, RIDGE, SUMS, BINS = 384, 1.0, 1e-4, 16, 1000
THRESHOLD = 0.3

_KIND = np.zeros((256, 9))
for _c in range(256):
    _s = chr(_c)
    _KIND[_c] = [_c >= 0x80, _s.isascii() and _s.islower(), _s.isascii() and _s.isupper(), _s.isascii() and _s.isdigit(), _c in b" \t", _c in b"\r\n", _c in b".,;:'\"()-", _c in b"!?", _c < 0x80 and not _s.isalnum() and not _s.isspace() and _c not in b".,;:'\"()-!?"]
STATISTICS = 9 + 14


def statistics(text: str | None) -> list[float]:
    """The statistics of a text; all are finite, also for an empty one."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(len(raw), 1)
    counts = np.bincount(raw, minlength=256)
    kinds = counts @ _KIND / n
    p = counts[counts > 0] / n
    words = (text or "").split()
    m = max(len(words), 1)
    each = Counter(words)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    most = each.most_common(1)[0][1] if each else 0
    repeats = sum(map(eq, words, words[1:])) / m
    bare = sum(not w[-1].isalnum() for w in words) / m
    return [
        *kinds.tolist(),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        math.log1p(len(raw)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        len(raw) / m if words else 0.0,
        math.sqrt(len(each) / m),
        len(each) / math.sqrt(m),
        most / m,
        math.sqrt(repeats),
        bare,
        len(set(lines)) / max(len(lines), 1),
        math.log1p(len(words) / max(len(lines), 1)),
        sum(w.isupper() for w in words) / m,
        sum(not any(map(str.isalnum, w)) for w in words if len(w) < 4) / m,
    ]


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, held_out, stats) of every row; held_out: crc32 of the id as text is divisible by 5 (or the id is null)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), stats], ["id", "stats"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = narrow.mapInArrow(each, T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))]))
    return out.select("id", held_out(F.col("id")).alias("held_out"), "stats")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _stack(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, STATISTICS)


class Fourier:
    """cos(Wx + b) of standardised, clipped statistics, and a constant; W and b follow from the seed."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: int = WIDTH, bandwidth: float = BANDWIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / (bandwidth * math.sqrt(STATISTICS)), (STATISTICS, width))
        self.b = rng.uniform(0, 2 * math.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b)), np.ones((len(x), 1))), 1)


def _summed(rows: DataFrame, of) -> np.ndarray | None:
    """The sum over all rows of of(stats, labels), an array of fixed shape: one of each partition, added up by SUMS tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = of(_stack(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for one in (np.frombuffer(v.as_py(), np.float64) for b in batches for v in b.column(0)):
            total = one.copy() if total is None else np.add(total, one, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    found = rows.mapInArrow(each, "total binary").repartition(SUMS, F.xxhash64("total")).mapInArrow(added, "total binary").collect()
    return sum(np.frombuffer(r["total"], np.float64) for r in found) if found else None


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means of bins by pooling neighbours that fall; bins without rows take the value before them."""
    blocks: list[list[float]] = []
    for s, c in zip(sums, counts):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), s / c if c else 0.0) for s, c, n in blocks])


class Model:
    """Fitted features, weights and calibration. Smoothing keeps probabilities off 0 and 1."""

    def __init__(self, rows: DataFrame):
        """rows: stats, label."""
        self.ok = False
        base = _summed(rows, lambda x, y: np.concatenate(([len(x), y.sum()], x.sum(0), np.square(x).sum(0))))
        if base is None:
            return
        n, mean = base[0], base[2 : 2 + STATISTICS] / base[0]
        scale = np.sqrt(np.maximum(base[2 + STATISTICS :] / n - mean**2, 0))
        self.features = features = Fourier(mean, np.where(scale > 1e-9, scale, 1.0))
        d = WIDTH + 1

        def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = features(x)
            return np.concatenate(((z.T @ z).ravel(), z.T @ y))

        sums = _summed(rows, equations)
        gram = sums[: d * d].reshape(d, d) + RIDGE * n * np.diag([*np.ones(WIDTH), 0.0]) + 1e-9 * np.eye(d)
        self.weights = weights = np.linalg.solve(gram, sums[d * d :])

        def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            at = self_bins(features(x) @ weights)
            return np.concatenate((np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)))

        hist = _summed(rows, binned)
        rate = base[1] / n
        sums, counts = hist[:BINS], hist[BINS:]
        used = counts > 0
        means = isotonic(sums[used] + rate * 1e-3, counts[used] + 1e-3)
        self.at, self.means, self.ok = np.flatnonzero(used).astype(float), np.clip(means, 0.0, 1.0), True

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score breaks ties inside a calibrated step."""
        if not self.ok:
            return np.full(len(x), 0.5)
        raw = np.clip(self.features(x) @ self.weights, -0.5, 1.5)
        return np.clip(0.999 * np.interp((raw + 0.5) / 2 * BINS - 0.5, self.at, self.means) + 0.001 * (raw + 0.5) / 2, 0.0, 1.0)


def self_bins(raw: np.ndarray) -> np.ndarray:
    return np.clip(((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs; only labels of rows not held out are learned from.

    Null and empty texts are scored by their statistics like others. Null labels are left out; repeated label rows count
    each. Without labels every score is 0.5. Repeated rows get equal scores; an empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        stats = staged(measured(docs, id_col, text_col))
        known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label")).filter("label IS NOT NULL")
        model = Model(staged(stats.filter(~F.col("held_out")).join(known, F.col("id") == F.col("label_id")).select("stats", "label")))
        keep(stats)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(_stack(b.column(2))))], ["id", "held_out", "score"])

    fields = [stats.schema["id"], stats.schema["held_out"], T.StructField("score", T.DoubleType())]
    return stats.mapInArrow(each, T.StructType(fields)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
