"""SimHash near-duplicate groups, found with pivot distance tables.

1. Every whole text gets a fingerprint: a bit is set if it is set in over half the shingle hashes.
2. Equal fingerprints collapse to one node, so a group of exact copies of any size costs one row from here on.
3. Each node gets its row of the pivot table: its Hamming distances to ``PIVOTS`` reference fingerprints.
4. Nodes meet in buckets of equal key bits. For fingerprints of 64 bits the keys are lossless: of g blocks at least
   g - distance are equal between two linked fingerprints, so each choice of that many blocks is a key. Distances to
   references concentrate around half the bits and cannot deal rows out by themselves; keys do that.
5. In a bucket a pair is discarded if any two pivot distances differ by more than the allowed distance (triangle
   inequality, so no link is lost); survivors are verified on the fingerprints.
6. A bucket gives a spanning forest of its links, never all pairs; components are contracted over these edges.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import meeting
from .common import lean_worker, scratch, staged

SEED = 42
PIVOTS = 16
#: Rows of a bucket compared as one group; larger buckets are dealt out in chunks of this size.
CHUNK = 4096
#: Shingles and pairs held in memory at once.
SHINGLES, PAIRS = 1 << 18, 1 << 17

#: Edges that one task may finish; more are contracted by joins first.
FINISH = 100_000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Hashes for a further word of 64 bits, mixed from the first ones."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * word) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in pieces of bounded size."""
    text = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    for k in range(0, n, SHINGLES):
        cuts = map(slice, starts[k : min(n, k + SHINGLES)].tolist(), last[k : k + SHINGLES].tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, cuts), itertools.repeat(SEED)), np.uint64, min(n - k, SHINGLES))


def majority(hashes: Iterator[np.ndarray], words: int = 1) -> bytes:
    """64 * words bits, little-endian: those that are set in over half the hashes; zero if there are none."""
    counts, n = np.zeros((8 * words, 8), np.int64), 0
    for h in hashes:
        n += len(h)
        for w in range(words):
            each = _mixed(h, w).view(np.uint8).reshape(-1, 8)
            if len(h) < 128:
                counts[8 * w : 8 * w + 8] += np.unpackbits(each, axis=1, bitorder="little").sum(0, dtype=np.int64).reshape(8, 8)
            else:
                for k in range(8):
                    counts[8 * w + k] += np.bincount(each[:, k], minlength=256) @ _BITS
    return np.packbits((2 * counts > n).astype(np.uint8), axis=1, bitorder="little").tobytes()


def fingerprint(text: bytes | None, shingle: int, words: int = 1) -> bytes:
    """The majority of the hashes of all shingles; zero for a text without words (or null)."""
    found = (text or b"").lower().split()  # bytes: A-Z only, and white space is exactly 0x20 and 0x09-0x0D
    return majority(_hashes(found, shingle), words) if found else bytes(8 * words)


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """One row for each row of df: ``id`` and ``fp`` (binary, 8 bytes). Null texts count as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = pa.array((fingerprint(t.as_py(), shingle) for t in texts), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["id", "fp"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(each, T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("fp", T.BinaryType())]))


def hex_of(fp: Column) -> Column:
    """The 64-bit fingerprint as 16 lower-case hex digits, most significant first."""
    return F.lower(F.concat(*[F.hex(F.substring(fp, k, 1)) for k in range(8, 0, -1)]))


def references(words: int, pivots: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: (pivots, words), fixed by rule so that every run and task has the same."""
    return np.array([[xxhash.xxh64_intdigest(f"{p}/{w}", SEED) for w in range(words)] for p in range(pivots)], np.uint64)


def key_masks(distance: int, nodes: int) -> list[np.ndarray]:
    """Masks of the bits (bit numbers) that make up each bucket key of fingerprints of 64 bits.

    g blocks, choose g - distance of them; g is distance + 2 or the least above that leaves about 8 nodes or fewer by
    chance in a bucket. The keys are lossless.
    """
    g = distance + 2
    while nodes / 2 ** (64 * (g - distance) / g) > 8 and g < distance + 6:
        g += 1
    blocks = np.array_split(np.arange(64), g)
    return [np.concatenate(c) for c in itertools.combinations(blocks, g - distance)]


def _keys(fps: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, bit in enumerate(mask):
        out |= ((fps[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def _fps(column: pa.Array, words: int) -> np.ndarray:
    """The first words of each value; a value may go on after its fingerprint."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)[:, :words] if len(column) else np.zeros((0, words), np.uint64)


def bucketed(nodes: DataFrame, masks: list[np.ndarray]) -> DataFrame:
    """(mask_no, key, fp, pivots) for every node and mask; pivots holds a distance of two bytes for each reference."""
    refs = references(1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = _fps(b.column(0), 1)
            if not len(fps):
                continue
            table = np.stack([np.bitwise_count(fps ^ r).sum(1) for r in refs], 1).astype(np.uint16)
            rows = pa.array([r.tobytes() for r in table], pa.binary())
            for no, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), no, np.int32)), pa.array(_keys(fps, mask)), b.column(0), rows], ["mask_no", "key", "fp", "pivots"])

    return nodes.select("fp").mapInArrow(each, "mask_no int, key bigint, fp binary, pivots binary")


def _own_pivots(fps: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The pivot table of each run of equal group numbers for references from the run itself, evenly spaced.

    Wide fingerprints are all about equally far from a reference drawn at random; one out of the bucket parts what is
    near it from the rest.
    """
    starts = np.searchsorted(group, group)
    sizes = np.searchsorted(group, group, side="right") - starts
    return np.stack([np.bitwise_count(fps ^ fps[starts + k * sizes // PIVOTS]).sum(1) for k in range(PIVOTS)], 1).astype(np.int16)


def _forest(fps: np.ndarray, pivots: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each run of equal group numbers; rows are sorted by group.

    Pairs are made run by run in pieces of bounded size; a pair that is already connected is not looked at again.
    """
    n = len(fps)
    root = np.arange(n)
    ends = np.searchsorted(group, group, side="right")
    todo = ends - np.arange(n) - 1
    a_out, b_out = [], []
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(np.cumsum(todo[at:]), PAIRS)) + at)
        counts = todo[at:upto]
        total = int(counts.sum())
        if total:
            i = np.repeat(np.arange(at, upto), counts)
            j = i + 1 + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            for p in range(pivots.shape[1]):  # the pivot table: |d(x, p) - d(y, p)| <= d(x, y)
                near = np.abs(pivots[i, p] - pivots[j, p]) <= distance
                i, j = i[near], j[near]
            if len(i):
                near = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64) <= distance
                i, j = i[near], j[near]
            while len(i):
                a, b = root[i], root[j]
                high, low = np.maximum(a, b), np.minimum(a, b)
                hooked = root.copy()
                np.minimum.at(hooked, high, low)
                moved = np.unique(high)
                a_out.append(moved)
                b_out.append(hooked[moved])
                root = hooked
                while not np.array_equal(root, root[root]):
                    root = root[root]
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
        at = upto
    none = np.zeros(0, np.int64)
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (none, none)


def _linked(words: int, distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges from partitions that are sorted by (mask_no, key, part): a bucket may go on in the next batch."""

    def found(t: pa.Table) -> pa.RecordBatch:
        fps = _fps(t["fp"], words)
        keys = np.stack([t[c].to_numpy() for c in ("mask_no", "key", "part")], 1)
        group = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(1))))
        pivots = np.frombuffer(b"".join(t["pivots"].to_pylist()), np.uint16).reshape(len(fps), -1).astype(np.int16) if "pivots" in t.column_names else _own_pivots(fps, group)
        a, b = _forest(fps, pivots, group, distance)
        kept = t["fp"].combine_chunks()
        return pa.RecordBatch.from_arrays([kept.take(pa.array(a)).cast(pa.binary()), kept.take(pa.array(b)).cast(pa.binary())], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            last = [t[c][-1].as_py() for c in ("mask_no", "key", "part")]
            same = np.logical_and.reduce([t[c].to_numpy() == v for c, v in zip(("mask_no", "key", "part"), last)])
            cut = int(np.argmax(same))
            if cut:
                yield found(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield found(rest)

    return each


def links(rows: DataFrame, distance: int, words: int = 1) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span every component of the links inside buckets.

    rows: mask_no, key and fp, distinct (mask_no and key name the bucket), and pivots if the references are global.
    Buckets of over CHUNK rows are dealt out (meeting.spanning); no pair is missed.
    """
    return meeting.spanning(rows, ["mask_no", "key"], "fp", F.lit(1), CHUNK, CHUNK, _linked(words, distance), components)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, to) for every node of edges (a, b), with the component's smallest node, by union and find."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([top(x) for x in nodes], pa.binary())], ["a", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), by contraction.

    Each round maps a node to the smallest of its closed neighbourhood in a random order that changes by round, then
    keeps edges between what is left. Minima combine before the shuffle, so a node of high degree is no hot task. Once
    FINISH edges or fewer are left, one task finishes them; that bound is the task's memory, not a limit on the result.
    """
    edges = staged(edges)
    label: DataFrame | None = None
    for turn in itertools.count():
        left = edges.count()
        if not left:
            break
        if left <= FINISH:
            to = staged(edges.select("a", "b").coalesce(1).mapInArrow(_finished, "a binary, to binary"))
        else:
            both = edges.select("a", "b").union(edges.select("b", "a"))
            order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
            to = staged(both.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least(order("a"), F.col("m"))["x"].alias("to")))
        named = to.select(F.col("a").alias("node"), F.col("to").alias("root"))
        label = named if label is None else staged(label.join(to, F.col("root") == F.col("a"), "left").select("node", F.coalesce("to", "root").alias("root")))
        if left <= FINISH:
            break
        edges = staged(edges.join(to, "a").select(F.col("to").alias("x"), "b").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component) for every row of df: component is the smallest id reachable over links, its own included.

    Texts without words, null ones included, have the fingerprint zero and link to each other like any others. A row
    without id takes part in links and gets the component of its group (null if no row of the group has an id).
    Repeated rows share a fingerprint and so a component. An empty table gives no rows. Other columns are not read.
    """
    with scratch(df.sparkSession) as keep:
        rows = staged(fingerprints(df, id_col, text_col, shingle))
        nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("least")))
        found = components(links(bucketed(nodes, key_masks(distance, nodes.count())), distance))
        roots = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        grouped = found.select(F.col("root")).distinct().join(roots, "root").groupBy("root").agg(F.min("least").alias("component"))
        to = staged(roots.join(grouped, "root", "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "least").alias("component")))
        keep(rows, to)
    return rows.join(to, F.col("fp") == F.col("fp_")).select("id", "fp", "component")
