"""Byte-pair merges learned over words that stand in chunks of coded symbols.

Words are staged once, some thousands to a row: the symbols they hold, and their codes in one buffer. A pass is one job
over these rows: a task does the merges since the words were staged, counts the neighbours that are left, and adds them up
before the only shuffle, that of distinct pairs. After ``PASSES`` passes the words are staged anew as they are then, so a
pass does a bounded number of merges on each chunk, and its work grows with the words and nothing else.

Several merges go in one pass where that gives the merges of one at a time. Pairs are taken in order of their counts up to
the first that shares a symbol with one taken before. New pairs hold a product of a pair taken; each of their occurrences
was one of a pair that shares a symbol with it, so their counts are at most that of the first pair left; pairs that
count more are safe. A pair of two equal symbols, or whose product is a symbol already, goes alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import Log, staged

END = "</w>"
#: Passes between two stagings of the words, and pairs that are looked at for a pass.
PASSES, TOP = 12, 64
#: Symbols of a chunk (a longer word is a chunk of its own), and pairs that a task adds up before it hands them on.
CHUNK, HELD = 1 << 18, 1 << 19
#: Distinct symbols of a chunk up to which its pairs are counted in a table of all of them.
_DENSE = 1 << 11
_MARK = "\u0001"

#: SQL of symbols with each of the pairs named in `names` joined, from left to right and without overlaps.
_MERGED = f"""aggregate(symbols, struct(CAST(array() AS array<string>) AS out, false AS fresh), (acc, x) ->
  CASE WHEN size(acc.out) > 0 AND NOT acc.fresh AND array_contains(names, concat(element_at(acc.out, -1), '{_MARK}', x))
    THEN struct(concat(slice(acc.out, 1, size(acc.out) - 1), array(concat(element_at(acc.out, -1), x))) AS out, true AS fresh)
    ELSE struct(concat(acc.out, array(x)) AS out, false AS fresh) END, acc -> acc.out)"""


def merged(words: DataFrame, pairs: list[tuple[str, str]], out: str = "new") -> DataFrame:
    """words (symbols and others) with the symbols after joining each of the pairs, no two of which share a symbol."""
    names = F.array(*[F.lit(a + _MARK + b) for a, b in pairs])
    return words.withColumn("names", names).withColumn(out, F.expr(_MERGED)).drop("names")


def safe_batch(ranked: list[tuple[str, str, int]], made: set[str], more: bool) -> list[tuple[str, str, int]]:
    """The merges that one pass may do, of the best pairs in order; more: whether there are pairs beyond them."""
    first = ranked[0]
    alone = lambda p: p[0] == p[1] or p[0] + p[1] in made
    if alone(first):
        return [first]
    out, held = [first], {first[0], first[1], first[0] + first[1]}
    bound = ranked[-1][2] if more else 0
    for p in ranked[1:]:
        own = {p[0], p[1], p[0] + p[1]}
        if alone(p) or own & held:
            bound = p[2]
            break
        out.append(p)
        held |= own
    return [p for p in out if p is first or p[2] > bound]


def _lengths(words: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(words.column("symbols")), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(words: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """(symbols, codes) of words; -1 follows the codes of each word."""
    lengths = _lengths(words)
    flat = words.column("symbols").flatten().dictionary_encode()
    codes = np.full(len(flat) + len(lengths), -1, np.int32)
    codes[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = flat.indices.to_numpy(zero_copy_only=False)
    return flat.dictionary.to_pylist(), codes


def _joined(codes: np.ndarray, a: int, b: int, product: int) -> np.ndarray:
    """codes with a and b as neighbours made one, from left to right and without overlaps."""
    at = np.flatnonzero((codes[:-1] == a) & (codes[1:] == b))
    if a == b and len(at):  # of a run of equal symbols every second place
        k = np.arange(len(at))
        starts = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, k, 0))
        at = at[(k - starts) % 2 == 0]
    if not len(at):
        return codes
    out = codes.copy()
    out[at] = product
    return np.delete(out, at + 1)


def _after(names: list[str], codes: np.ndarray, pairs: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """A chunk's symbols and codes after merges, one after the other."""
    names, place = list(names), {x: k for k, x in enumerate(names)}
    for a, b in pairs:
        if a in place and b in place:
            product = place.get(a + b, len(names))
            done = _joined(codes, place[a], place[b], product)
            if done is not codes and product == len(names):
                place[a + b] = product
                names.append(a + b)
            codes = done
    return names, codes


def _pairs(names: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, word) of each pair of neighbours of a chunk; a key is left times the number of symbols, and right."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    return at, codes[at].astype(np.int64) * len(names) + codes[at + 1], np.cumsum(codes < 0)[at]


def _sums(keys: np.ndarray, weights: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their weights), in whole numbers."""
    if symbols <= _DENSE:
        total = np.zeros(symbols * symbols, np.int64)
        np.add.at(total, keys, weights)
        found = np.flatnonzero(total)
        return found, total[found]
    found, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, weights)
    return found[total != 0], total[total != 0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, pa.Array]]:
    """(symbols, codes, freq of words, order of words) of staged chunks."""
    for b in batches:
        for names, codes, freq, order in zip(*(b.column(c) for c in ("names", "codes", "freq", "order"))):
            yield names.as_py(), np.frombuffer(codes.as_py(), "<i4"), np.frombuffer(freq.as_py(), "<i8"), order.values


def _chunk(names: list[str], codes: np.ndarray, freq: np.ndarray, order: pa.Array) -> pa.RecordBatch:
    orders = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), order)
    columns = [pa.array([names], pa.list_(pa.string())), pa.array([codes.astype("<i4").tobytes()], pa.binary()), pa.array([freq.astype("<i8").tobytes()], pa.binary()), orders]
    return pa.RecordBatch.from_arrays(columns, ["names", "codes", "freq", "order"])


def _counted(held: dict[tuple[str, str], int]) -> pa.RecordBatch:
    left, right = zip(*held) if held else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(list(held.values()), pa.int64())], ["left", "right", "freq"])


class _Words:
    """Words in chunks, and the merges since they were staged."""

    def __init__(self, chunks: DataFrame):
        self.chunks, self.since, self.passes = staged(chunks), [], 0

    @classmethod
    def of(cls, words: DataFrame) -> _Words:
        """words: symbols, freq, order."""

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(_lengths(b)) // CHUNK)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(cuts, cuts[1:]):
                    if hi > lo:
                        own = b.slice(lo, hi - lo)
                        yield _chunk(*_coded(own), pc.fill_null(own.column("freq"), 0).to_numpy(zero_copy_only=False), own.column("order"))

        kind = words.schema["order"].dataType.simpleString()
        rows = words.select("symbols", F.col("freq").cast("bigint").alias("freq"), "order")
        return cls(rows.mapInArrow(chunks, f"names array<string>, codes binary, freq binary, `order` array<{kind}>"))

    def restaged(self) -> _Words:
        pairs = list(self.since)

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, codes, freq, order in _chunks(batches):
                yield _chunk(*_after(names, codes, pairs), freq, order)

        return _Words(self.chunks.mapInArrow(chunks, self.chunks.schema))

    def compound(self) -> bool:
        """Whether a symbol other than the end mark has several characters."""
        return bool(self.chunks.filter(F.exists("names", lambda s: (F.char_length(s) > 1) & (s != END))).limit(1).count())

    def counts(self) -> DataFrame:
        """(left, right, freq) of all pairs."""
        pairs = list(self.since)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[str, str], int] = {}
            for names, codes, freq, _ in _chunks(batches):
                names, codes = _after(names, codes, pairs)
                _, keys, word = _pairs(names, codes)
                for k, n in zip(*(x.tolist() for x in _sums(keys, freq[word], len(names)))):
                    p = names[k // len(names)], names[k % len(names)]
                    held[p] = held.get(p, 0) + n
                if len(held) > HELD:
                    yield _counted(held)
                    held = {}
            yield _counted(held)

        rows = self.chunks.mapInArrow(each, "left string, right string, freq bigint")
        return rows.groupBy("left", "right").agg(F.sum("freq").alias("freq"))

    def first_counts(self) -> DataFrame:
        """(left, right, freq, first): first is the (order, at) where a pair stands first in the words' order."""
        pairs = list(self.since)
        kind = self.chunks.schema["order"].dataType.elementType.simpleString()

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, codes, freq, order in _chunks(batches):
                names, codes = _after(names, codes, pairs)
                at, keys, word = _pairs(names, codes)
                found, total = _sums(keys, freq[word], len(names))
                at = at - np.concatenate(([0], np.flatnonzero(codes < 0) + 1))[word]
                place = np.asarray(pc.rank(order, "ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)
                by = np.lexsort((at, place[word], keys))
                first = by[np.unique(keys[by], return_index=True)[1]]
                first = first[np.isin(keys[first], found)]
                sides = [pa.array([names[k] for k in side.tolist()], pa.string()) for side in (found // len(names), found % len(names))]
                columns = [*sides, pa.array(total), order.take(pa.array(word[first])), pa.array(at[first].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["left", "right", "freq", "order", "at"])

        rows = self.chunks.mapInArrow(each, f"left string, right string, freq bigint, `order` {kind}, at bigint")
        return rows.groupBy("left", "right").agg(F.sum("freq").alias("freq"), F.min(F.struct("order", "at")).alias("first"))


def _touched(vocab: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(word) of the words that merges change."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = np.diff(np.flatnonzero(_after(*_coded(b), pairs)[1] < 0), prepend=-1) - 1
            yield b.select(["word"]).filter(pa.array(left < _lengths(b)))

    kind = vocab.schema["word"].dataType.simpleString()
    return vocab.select("word", "symbols").mapInArrow(each, f"word {kind}")


def learned(vocab: DataFrame, merges: int, order: str | None = None) -> tuple[DataFrame, dict]:
    """((merge_no, left, right, freq), what it took) for words (word, symbols, freq), the most frequent pair first.

    Ties go to the pair that stands first in the words' order (column `order`; one merge a pass then), else to the
    smaller pair. The rows come from the staged best pairs of each pass, TOP of them; the driver sees those alone. Of what
    it took, touched (the words that merges change) is worked out when it is asked for.
    """
    spark = vocab.sparkSession
    words = _Words.of(vocab.select("symbols", "freq", (F.col(order) if order else F.lit(0)).alias("order")))
    single = order is not None or words.compound()  # symbols of several characters may be products already
    made, numbers, turn = {END}, {}, 0
    every: list[tuple[str, str]] = []
    log = None
    while len(numbers) < merges:
        if words.passes >= PASSES:
            words = words.restaged()
        counts = words.first_counts() if order else words.counts()
        best = counts.orderBy(F.desc("freq"), *(["first"] if order else []), "left", "right").limit(1 if order else TOP)
        best = best.select(F.lit(turn).alias("turn"), "left", "right", "freq")
        log = log or Log(spark, best.schema)
        log.add(best)
        found = log.read().filter(F.col("turn") == turn).collect()
        ranked = sorted(((r["left"], r["right"], r["freq"]) for r in found), key=lambda p: (-p[2], p[0].encode(), p[1].encode()))
        if not ranked:
            break
        batch = (ranked[:1] if single else safe_batch(ranked, made, len(ranked) == TOP))[: merges - len(numbers)]
        for a, b, _ in batch:
            numbers[f"{turn}{_MARK}{a}{_MARK}{b}"] = len(numbers)
            made.add(a + b)
            every.append((a, b))
            words.since.append((a, b))
        words.passes += 1
        turn += 1
    if not numbers:
        return spark.createDataFrame([], "merge_no int, left string, right string, freq bigint"), {"passes": 0, "touched": None}
    number = F.from_json(F.lit(json.dumps(numbers)), "map<string,int>")
    rows = log.read().withColumn("merge_no", F.try_element_at(number, F.concat_ws(_MARK, F.col("turn").cast("string"), "left", "right")))
    return rows.filter("merge_no IS NOT NULL").select("merge_no", "left", "right", "freq"), {"passes": turn, "touched": _touched(vocab, every)}
