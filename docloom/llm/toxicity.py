"""Toxicity severity by cumulative-link (proportional odds) ordinal regression over sparse text features.

Features are whole words and word beginnings of 4, 5 and 6 letters: whether a document has one and how large a share of
its words it takes. Grades are whole numbers from 0 that come with the labels, never from a text. One weight vector is
shared by all thresholds: P(grade <= k) = sigmoid(threshold_k - w.x). The expected severity is the sum of P(grade >= k).

Fitting uses a bounded sample of labelled rows (``SAMPLE`` of grade 0 and as many of the others, those of the smallest
hashes of their ids, one text each), staged once; the sample's ids are broadcast under that bound. Scoring is one pass
over the documents without a shuffle: Arrow parts texts into words and tells them apart, Python sees each distinct word
of a stretch of text once, and the rest are sums over arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import distinct_name, lean_worker, scratch, staged

#: Labelled rows to fit on, of grade 0 and of the others, and features to keep.
SAMPLE, FEATURES = 10_000, 4096
#: A feature is kept if so many positive documents have it, its odds differ by this factor and its chi-square is this high.
SUPPORT, ODDS, CHI = 3, 3.0, 20.0
STARTS = (4, 5, 6)
REJECT = 0.5
#: Features counted in memory at once.
COUNTED = 200_000
#: Words whose features are remembered at once, and bytes of text that are parted together.
WORDS, TEXTS = 400_000, 1 << 22


def features_of(word: str) -> list[tuple[int, str]]:
    """(kind, text): kind 0 for the word, else the number of its first letters."""
    return [(0, word), *((n, word[:n]) for n in STARTS if len(word) > n)]


def stretches(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in slices of about TEXTS bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    k = 0
    while k < len(texts):
        upto = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + TEXTS)))
        yield texts.slice(k, upto - k)
        k = upto


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, number of the word) of every word of the texts, and the distinct words; a word is a run of letters in lower case."""
    bare = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(bare))
    told = split.flatten()
    offsets = split.offsets.to_numpy()
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    some = pc.not_equal(told, "")  # a text without letters splits into one empty word
    if not pc.all(some).as_py():
        rows, told = rows[some.to_numpy(zero_copy_only=False)], told.filter(some)
    told = told.dictionary_encode()
    return rows, told.indices.to_numpy(), told.dictionary.to_pylist()


@dataclass
class Model:
    """Feature numbers, weights (presence, then share), thresholds of grades 1 and up."""

    index: dict[tuple[int, str], int]
    weights: np.ndarray
    thresholds: np.ndarray
    _words: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, words that have it) of the features found, by row and feature, and the words of each row."""
        rows, at, words = words_of(texts)
        if len(self._words) > WORDS:
            self._words.clear()
        held = []
        for w in words:
            hit = self._words.get(w)
            if hit is None:
                hit = self._words[w] = tuple(self.index[f] for f in features_of(w) if f in self.index)
            held.append(hit)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        flat = np.fromiter((f for hit in held for f in hit), np.int64, int(sizes.sum()))
        starts = sizes.cumsum() - sizes
        counts = np.bincount(rows, minlength=len(texts))
        some = sizes[at] > 0
        rows, at = rows[some], at[some]
        each = sizes[at]
        found = flat[np.repeat(starts[at] - (each.cumsum() - each), each) + np.arange(int(each.sum()))]
        width = max(len(self.index), 1)
        both, n = np.unique(np.repeat(rows, each) * width + found, return_counts=True)
        return both // width, both % width, n, counts

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        at = 0
        for part in stretches(texts):
            row, f, n, words = self.entries(part)
            out[at : at + len(part)] = np.bincount(row, self.weights[f] + self.weights[len(self.index) + f] * share(n, words[row]), len(part))
            at += len(part)
        return out

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 on, a column each."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def share(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, 10 * count / np.maximum(words, 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, ridge: float = 1e-6, steps: int = 500, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the proportional odds model by Adam on the whole sample; entries are (row, col, value)."""
    n, top = len(grades), int(grades.max())
    w, gaps = np.zeros(width), np.concatenate(([1.0], np.zeros(top - 1)))  # thresholds: a start and logs of the steps
    m, v = np.zeros(width + top), np.zeros(width + top)
    for step in range(1, steps + 1):
        t = gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))
        z = np.bincount(rows, values * w[cols], n)
        below = np.concatenate((np.zeros((n, 1)), _sigmoid(t[None, :] - z[:, None]), np.ones((n, 1))), 1)
        slope = below * (1 - below)
        at = np.arange(n)
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        up, low = slope[at, grades + 1] / p, slope[at, grades] / p  # of the upper and lower threshold of the grade
        dz = (up - low) / n
        dt = np.zeros(top + 2)
        np.add.at(dt, grades + 1, -up / n)
        np.add.at(dt, grades, low / n)
        dt = dt[1:-1]
        g = np.concatenate((np.bincount(cols, values * dz[rows], width) + ridge * w, [dt.sum()], [dt[k:].sum() * np.exp(gaps[k]) for k in range(1, top)]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, gaps = w - move[:width], gaps - move[width:]
    return w, gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))


def graded(labels: DataFrame, id_col: str = "doc_id", toxic_col: str = "toxic", quality_col: str = "quality") -> DataFrame:
    """(id, grade) from the annotators' two labels: 0 not toxic, 1 toxic, 2 toxic and of low quality as well.

    Rows without id or toxic label are left out; of repeated ids the highest grade counts.
    """
    low = F.coalesce(F.col(quality_col).cast("int") == 0, F.lit(False)) if quality_col in labels.columns else F.lit(False)
    grade = F.when(F.col(toxic_col).cast("int") > 0, 1 + low.cast("int")).otherwise(0)
    return labels.filter(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).select(F.col(id_col).alias("id"), grade.alias("grade"))


def _sampled(docs: DataFrame, grades: DataFrame, sample: int) -> DataFrame:
    """(grade, text) of the labelled sample: of rows under one id the one of the least text hash."""
    one = grades.filter("grade IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.max(F.col("grade").cast("int")).alias("grade"))
    drawn = [one.filter(own).orderBy(F.xxhash64("id"), "id").limit(sample) for own in ("grade = 0", "grade > 0")]
    ids = F.broadcast(drawn[0].union(drawn[1]))  # at most 2 * sample rows
    text = F.coalesce("text", F.lit(""))
    return docs.join(ids, "id").groupBy("id", "grade").agg(F.min_by(text, F.xxhash64(text)).alias("text")).select("grade", "text")


def _counted(drawn: DataFrame) -> DataFrame:
    """(kind, part, clean, toxic): documents of grade 0 and above that have a feature; kind -1 counts all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            every = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array([f[0] for f in every], pa.int32()), pa.array([f[1] for f in every], pa.string()), *[pa.array([seen[v][f] for f in every], pa.int64()) for v in (0, 1)]], ["kind", "part", "clean", "toxic"])
            for held in seen:
                held.clear()
            return out

        lean_worker()
        for b in batches:
            at = 0
            for texts in stretches(b.column(1)):
                rows, own, words = words_of(texts)
                pairs = np.unique(rows * max(len(words), 1) + own)
                cuts = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(len(words), 1))
                for k, grade in enumerate(b.column(0).slice(at, len(texts)).to_pylist()):
                    held = {f for w in (pairs[cuts[k] : cuts[k + 1]] % max(len(words), 1)).tolist() for f in features_of(words[w])}
                    seen[grade > 0].update(held)
                    seen[grade > 0][(-1, "")] += 1
                    if len(seen[0]) + len(seen[1]) > COUNTED:
                        yield told()
                at += len(texts)
        yield told()

    return drawn.mapInArrow(count, "kind int, part string, clean bigint, toxic bigint").groupBy("kind", "part").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter((F.col("toxic") >= SUPPORT) | (F.col("kind") == -1))


def fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model | None:
    """docs: id, text; grades: id, grade. None if the sample holds grade 0 only, or does not hold it."""
    with scratch(docs.sparkSession):
        drawn = staged(_sampled(docs, grades, sample))
        counted = staged(_counted(drawn))
        totals = counted.filter("kind = -1").collect()
        if not totals or not totals[0]["clean"] or not totals[0]["toxic"]:
            return None
        clean, toxic = float(totals[0]["clean"]), float(totals[0]["toxic"])
        a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
        odds = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))
        n = clean + toxic
        chi = n * F.pow(a * (clean - b) - b * (toxic - a), F.lit(2)) / ((a + b) * (n - a - b + 1) * toxic * clean)
        top = counted.filter("kind >= 0").select("kind", "part", odds.alias("odds"), chi.alias("chi")).filter((F.col("odds") >= ODDS) & (F.col("chi") >= CHI)).orderBy(F.desc("chi"), "kind", "part").limit(features).collect()
        model = Model({(r["kind"], r["part"]): k for k, r in enumerate(top)}, np.zeros(2 * len(top)), np.zeros(0))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean_worker()
            for b in batches:
                at = 0
                for texts in stretches(b.column(1)):
                    row, f, count, words = model.entries(texts)
                    cuts = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
                    lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in (f, count)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)).cast(pa.int32()), pa.array(words, pa.int64()), *lists], ["grade", "words", "f", "n"])
                    at += len(texts)

        # one row of numbers for each text of the sample
        sparse = drawn.mapInArrow(encode, "grade int, words bigint, f array<bigint>, n array<bigint>").collect()
    sparse.sort(key=lambda r: (r["grade"], r["words"], r["f"], r["n"]))  # the order of rows moves sums by rounding
    known = np.array([r["grade"] for r in sparse])
    rows = np.repeat(np.arange(len(sparse)), [len(r["f"]) for r in sparse])
    cols = np.array([f for r in sparse for f in r["f"]], np.int64)
    part = share(np.array([c for r in sparse for c in r["n"]], np.int64), np.array([r["words"] for r in sparse], np.int64)[rows])
    model.weights, model.thresholds = fit_ordinal(np.concatenate((rows, rows)), np.concatenate((cols, cols + len(top))), np.concatenate((np.ones(len(cols)), part)), known, 2 * len(top))
    return model


def severity(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with severity (expected grade), grade (the highest that is at least as likely reached as not), p_toxic
    (P(grade >= 1)) and toxic (p_toxic >= REJECT).

    Null and empty texts have no features and the severity of a document without any. Without a model (no labels, or
    one label only) the severity is 0. Every row and column stays; new names that are taken get underscores.
    """
    names = [distinct_name(docs, c) for c in ("severity", "grade", "p_toxic", "toxic")]
    types = [T.DoubleType(), T.IntegerType(), T.DoubleType(), T.BooleanType()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for b in batches:
            p = np.zeros((b.num_rows, 1)) if model is None else model.above(model.score(b.column(text_col)))
            found = [pa.array(p.sum(1)), pa.array((p >= REJECT).sum(1), pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 0] >= REJECT)]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *names])

    plain = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return plain.mapInArrow(each, T.StructType([*plain.schema.fields, *[T.StructField(c, t) for c, t in zip(names, types)]]))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as fit() takes them."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
