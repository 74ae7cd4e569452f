"""SimHash near-duplicate groups of texts whose shingle sets have a Jaccard similarity of at least a bound.

1. Every whole text becomes the set of its shingle hashes; a fingerprint of ``WORDS`` times 64 bits is the majority of
   the set. Rows alike in id and text collapse to one, equal sets to one node.
2. Nodes meet in buckets. Keys of fingerprint bits would have to be many and wide at this bound (0.8 of the shingles are
   0.85 of the bits: 635 keys of 30 bits find 0.99 of the pairs), so a key is the least values of the set under ROWS
   mixed orders: of KEYS keys a pair of similarity s shares one with probability 1 - (1 - s ** ROWS) ** KEYS, which is
   0.99998 at 0.8 and more above, at any number of nodes.
3. In a bucket the pivot table discards pairs (references from the bucket) and the fingerprints verify the others at
   ``DISTANCE``, 4.5 standard deviations above the mean of the worst sets at 0.8. This is ``simhash.links``: a spanning
   forest of what is left. Its components hold candidates only, few documents of a corpus.
4. The sets of those alone are made from their texts again; all pairs of a component that its fingerprints leave are
   compared exactly, in chunks if it is large (see meeting). A link counts also if its two nodes shared no key.
5. The verified links are contracted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import meeting
from .common import lean_worker, scratch, staged
from .simhash import _fps, _hashes, components, links, majority

#: Words of a fingerprint, and the bits in which two of them may differ.
WORDS, DISTANCE = 4, 76
#: Values in a key, and keys.
ROWS, KEYS = 5, 28
#: Nodes and hashes of a chunk; a candidate component beyond either is dealt out in chunks.
CHUNK, HASHES = 1024, 1 << 19
#: Values of the mixed orders held at once.
HELD = 1 << 17

_RNG = np.random.default_rng(20)
_FLIPS = _RNG.integers(0, 1 << 64, ROWS * KEYS, np.uint64)
_FACTORS = _RNG.integers(0, 1 << 64, ROWS * KEYS, np.uint64) | np.uint64(1)


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; none for a text without words (or null)."""
    found = (text or b"").lower().split()
    return np.unique(np.concatenate(list(_hashes(found, shingle)))) if found else np.zeros(0, np.uint64)


def node_of(hashes: np.ndarray) -> bytes:
    """What names a set: its fingerprint, then a digest of its hashes."""
    return majority(iter([hashes]), WORDS) + xxhash.xxh3_128_digest(hashes.tobytes())


def keys(hashes: np.ndarray) -> np.ndarray:
    """KEYS bucket keys of a set that is not empty."""
    least = np.full(ROWS * KEYS, np.iinfo(np.uint64).max, np.uint64)
    step = HELD // (ROWS * KEYS)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), step):
            z = (hashes[None, k : k + step] ^ _FLIPS[:, None]) * _FACTORS[:, None]
            least = np.minimum(least, (z ^ (z >> np.uint64(32))).min(1))
    own = np.concatenate((least.reshape(KEYS, ROWS), np.arange(KEYS, dtype=np.uint64)[:, None]), 1)
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in own], np.uint64).view(np.int64)


def _read(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, print, text): print is a hash of the text, null for a null one."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), F.when(text.isNotNull(), F.xxhash64(text)).alias("print"), text.alias("text"))


def measured(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """One row for each row of df: id, print, node and keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            nodes, met = [], []
            for t in texts:
                found = shingles(t.as_py(), shingle)
                nodes.append(node_of(found))
                met.append(keys(found) if len(found) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(met, pa.list_(pa.int64()))], ["id", "print", "node", "keys"])

    narrow = _read(df, id_col, text_col)
    fields = T._parse_datatype_string("print bigint, node binary, keys array<bigint>").fields
    return narrow.mapInArrow(each, T.StructType([T.StructField("id", narrow.schema["id"].dataType), *fields]))


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(root, node, hashes) from rows (root, node, text); a text of another set (of equal print) is left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingles(t.as_py(), shingle) for t in part.column(2).cast(pa.binary())]
                same = pa.array([node_of(h) == n.as_py() for h, n in zip(found, part.column(1))], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([h.tobytes() for h in found], pa.binary())], ["root", "node", "hashes"]).filter(same)

    return rows.mapInArrow(each, "root binary, node binary, hashes binary")


def verified(fps: np.ndarray, found: list[np.ndarray], bound: float) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among the sets: shared hashes over all hashes at least bound.

    Only pairs that their fingerprints and sizes leave and that are not connected yet are compared.
    """
    n = len(found)
    sizes = np.array([len(h) for h in found], np.int64)
    order = np.lexsort((np.arange(n), sizes))
    sizes, fps = sizes[order], fps[order]
    if n < 2 or not sizes[-1]:
        return [], []
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.unique(np.concatenate([found[k] for k in order]), return_inverse=True)[1].astype(np.int32)
    held = np.zeros(int(flat.max()) + 1, bool)
    root = np.arange(n)
    a_out, b_out = [], []
    for i in range(n - 1):
        # The larger set of a link has at most sizes[i] / bound hashes.
        upto = int(np.searchsorted(sizes, sizes[i] / bound * (1 + 1e-12), side="right"))
        if not sizes[i] or upto <= i + 1:
            continue
        others = np.flatnonzero(root[i + 1 : upto] != root[i]) + i + 1
        others = others[np.bitwise_count(fps[others] ^ fps[i]).sum(1, dtype=np.int64) <= DISTANCE]
        if not len(others):
            continue
        held[flat[starts[i] : starts[i + 1]]] = True
        for j in others.tolist():
            if root[j] == root[i]:
                continue
            shared = int(np.count_nonzero(held[flat[starts[j] : starts[j + 1]]]))
            if shared >= bound * (sizes[i] + sizes[j] - shared) * (1 - 1e-12):
                a_out.append(int(order[i]))
                b_out.append(int(order[j]))
                root[root == root[j]] = root[i]
        held[flat[starts[i] : starts[i + 1]]] = False
    return a_out, b_out


def _linked(bound: float):
    """Edges from partitions sorted by (root, part, node): a group may go on in the next batch, a node comes once."""

    def edges(nodes: list[bytes], found: list[bytes]) -> pa.RecordBatch:
        fps = _fps(pa.array([x[: 8 * WORDS] for x in nodes], pa.binary()), WORDS)
        a, b = verified(fps, [np.frombuffer(h, np.uint64) for h in found], bound)
        return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in own], pa.binary()) for own in (a, b)], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        group, nodes, found = None, [], []
        for batch in batches:
            for root, part, node, hashes in zip(*(batch.column(c) for c in range(4))):
                now = (root.as_py(), part.as_py())
                if now != group:
                    if len(nodes) > 1:
                        yield edges(nodes, found)
                    group, nodes, found = now, [], []
                if not nodes or nodes[-1] != node.as_py():
                    nodes.append(node.as_py())
                    found.append(hashes.as_py())
        if len(nodes) > 1:
            yield edges(nodes, found)

    return each


def exact_links(sets: DataFrame, bound: float) -> DataFrame:
    """Edges (a, b) that span every component of the links inside the roots of sets (root, node, hashes)."""
    return meeting.spanning(sets, ["root"], "node", F.octet_length("hashes") / 8, CHUNK, HASHES, _linked(bound), components)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bound: float = 0.8) -> DataFrame:
    """(id, print, copies, component, first) for every distinct id and text of df.

    print is the text's xxhash64 (null for a null text), copies the number of rows alike in both, component the smallest
    id reachable over links, its own included (null if none has an id), first whether this is the group's first by id,
    null ids last, then print. Texts without words, null ones included, have the empty set and are alike. Repeated rows
    are one with copies above 1; two texts under one id are two. An empty table gives no rows. Other columns are not read.
    """
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", F.coalesce("print", F.lit(0)).alias("print"))
    with scratch(df.sparkSession) as keep:
        rows = staged(measured(df, id_col, text_col, shingle).groupBy("id", "print", "node").agg(F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")))
        nodes = staged(rows.groupBy("node").agg(F.min(rank).alias("least"), F.first("keys").alias("keys")))
        met = nodes.select(F.lit(0).alias("mask_no"), F.explode("keys").alias("key"), F.col("node").alias("fp"))
        near = components(links(met, DISTANCE, WORDS))
        asked = staged(near.join(nodes.select("node", "least"), "node").select("root", "node", F.col("least.id").alias("wanted"), F.col("least.print").alias("wanted_print")))
        texts = _read(df, id_col, text_col)
        texts = texts.join(asked, (F.col("print") == F.col("wanted_print")) & F.col("id").eqNullSafe(F.col("wanted")))
        found = components(exact_links(staged(_sets(texts.select("root", "node", "text"), shingle)), bound))
        roots = nodes.select("node", "least").join(found.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        grouped = found.select("root").distinct().join(roots, "root").groupBy("root").agg(F.min("least").alias("group_least"))
        to = staged(roots.join(grouped, "root", "left").select(F.col("node").alias("node_"), F.coalesce("group_least", "least").alias("least")))
        keep(rows, to)
    return rows.join(to, F.col("node") == F.col("node_")).select("id", "print", "copies", F.col("least.id").alias("component"), (F.col("least") == rank).alias("first"))
