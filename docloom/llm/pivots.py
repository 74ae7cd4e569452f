"""Near duplicates among vectors by a pivot-permutation index.

1. Equal vectors under one label collapse to one node.
2. ``PIVOTS`` reference vectors come from a bounded sample, no two of them near each other. A node is described by the
   ``NEAREST`` pivots it is nearest to, in order.
3. Two nodes are candidates if they share ``SHARED`` pivots or more. Pivots are ordered by how often they occur; the
   prefix of a node are its NEAREST - SHARED + s rarest pivots, and two candidates have s of them in common. So inverted
   lists by s pivots of the prefix hold every pair of candidates together, whatever s is: s grows with the number of
   nodes, which keeps the lists short and the candidates the same.
4. A list is compared in one task, or in chunks by pairs of chunks if it is long. Shared pivots are counted on bit sets
   of the descriptions; a pair is looked at in the list of its rarest s common pivots alone; survivors are verified by
   their cosine in double precision.
5. A task gives the number of links of each node and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import lean_worker, scratch, staged
from .simhash import components

#: Nodes that pivots are chosen from, pivots at most, and the cosine that two pivots stay below.
SAMPLE, PIVOTS, APART = 4096, 256, 0.9
#: Pivots that describe a node, and how many of them candidates share.
NEAREST, SHARED = 10, 4
#: Nodes of a list that are meant to meet; pivots in a key grow until lists are about this long.
LIST = 512
#: Least and most nodes of a chunk; in between a long list has MEETINGS chunks.
CHUNK, MOST, MEETINGS = 512, 16384, 8
#: Nodes of either side that are compared at once.
TILE = 1024
#: Cosines this near to the bound are computed again from the vectors themselves.
CLOSE = 1e-9


def chosen(vectors: np.ndarray, pivots: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Unit vectors, the first ones of which no two have a cosine of apart or more."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.zeros((0, vectors.shape[1]))
    for u in units:
        if len(out) == pivots:
            break
        if not len(out) or (out @ u).max() < apart:
            out = np.concatenate((out, u[None]))
    return out


def described(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first; ties to the smaller number."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, : min(NEAREST, len(pivots))]


def bit_sets(numbers: np.ndarray) -> np.ndarray:
    """(rows, 4) words of 64 bits with a bit for each number below 256."""
    out = np.zeros((len(numbers), 4), np.uint64)
    for column in numbers.T:
        out[np.arange(len(numbers)), column // 64] |= np.uint64(1) << (column % 64).astype(np.uint64)
    return out


def needed(pivots: int) -> int:
    """Pivots that candidates share, of so many in all; with no more than describe a node all rows share them."""
    return min(SHARED, pivots)


def prefixes(ranks: np.ndarray, shared: int, size: int) -> np.ndarray:
    """The rarest pivots of each row that two candidates have `size` of in common, ascending; ranks: rarest is 0."""
    return np.sort(ranks, axis=1)[:, : ranks.shape[1] - shared + size]


def _vectors(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) for each length that occurs."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return [(d, np.flatnonzero(sizes == d), flat[np.repeat(sizes == d, sizes)].reshape(-1, d)) for d in np.unique(sizes).tolist()]


def pivot_counts(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(dim, pivot, n): how many nodes a pivot describes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, _, x in _vectors(b.column(0)):
                n = np.bincount(described(x, pivots[dim]).reshape(-1), minlength=len(pivots[dim]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dim, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64))], ["dim", "pivot", "n"])

    return nodes.select("vector").mapInArrow(each, "dim int, pivot int, n bigint").groupBy("dim", "pivot").agg(F.sum("n").alias("n"))


_POSTING = "label string, dim int, key bigint, node binary, copies bigint, vector binary, pivots binary"


def postings(nodes: DataFrame, pivots: dict[int, np.ndarray], rank: dict[int, np.ndarray], size: int, keys_only: bool = False) -> DataFrame:
    """The inverted lists: a row for each node (node, label, copies, vector) and each choice of `size` prefix pivots.

    pivots: the bit set of the ranks of the node's pivots. keys_only: label, dim and key alone.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for b in batches:
            for dim, rows, x in _vectors(b.column("vector")):
                ranks = rank[dim][described(x, pivots[dim])]
                prefix = prefixes(ranks, needed(len(pivots[dim])), min(size, needed(len(pivots[dim]))))
                at = pa.array(rows)
                wide, sets = x.shape[1] * 8, bit_sets(ranks)
                vector = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
                own = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * 32, 32, dtype=np.int32)), pa.py_buffer(sets)])
                kept = [b.column(c).take(at) for c in ("label", "node", "copies")]
                for choice in itertools.combinations(range(prefix.shape[1]), min(size, needed(len(pivots[dim])))):
                    key = np.zeros(len(x), np.int64)
                    for c in choice:
                        key = key * 256 + prefix[:, c]
                    if keys_only:
                        yield pa.RecordBatch.from_arrays([kept[0], pa.array(np.full(len(x), dim, np.int32)), pa.array(key)], ["label", "dim", "key"])
                        continue
                    yield pa.RecordBatch.from_arrays([kept[0], pa.array(np.full(len(x), dim, np.int32)), pa.array(key), kept[1], kept[2], vector, own], ["label", "dim", "key", "node", "copies", "vector", "pivots"])

    return nodes.select("node", "label", "copies", "vector").mapInArrow(each, "label string, dim int, key bigint" if keys_only else _POSTING)


def _span(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links (i, j) between n rows."""
    root = np.arange(n)
    a_out, b_out = [], []
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        high, low = np.maximum(a, b), np.minimum(a, b)
        hooked = root.copy()
        np.minimum.at(hooked, high, low)
        moved = np.unique(high)
        a_out.append(moved)
        b_out.append(hooked[moved])
        root = hooked
        while not np.array_equal(root, root[root]):
            root = root[root]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (none, none)


class _Part:
    """Rows of one part of a list."""

    def __init__(self, rows: pa.Table, dim: int):
        self.nodes = rows["node"].to_pylist()
        self.copies = rows["copies"].to_numpy()
        self.x = np.frombuffer(b"".join(rows["vector"].to_pylist()), np.float64).reshape(len(self.nodes), dim)
        self.norm = np.linalg.norm(self.x, axis=1)
        self.units = self.x / self.norm[:, None]
        self.sets = np.frombuffer(b"".join(rows["pivots"].to_pylist()), np.uint64).reshape(-1, 4)
        self.chunk = rows["chunk"].to_numpy()


def _below(ranks: int) -> np.ndarray:
    """Four words with the bits of all ranks up to this one."""
    return np.array([(1 << max(0, min(64, ranks + 1 - 64 * w))) - 1 for w in range(4)], np.uint64)


def _meet(part: _Part, last: int, shared: int, size: int, width: int, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row, edges) of the pairs that this list owns. last: the key's last pivot."""
    n = len(part.nodes)
    links = np.zeros(n, np.int64)
    # A row's prefix are its `width` rarest pivots; the pair belongs to the list of its first `size` common ones.
    below = _below(last)
    prefix = _prefix_sets(part.sets, width)
    left, right = [], []
    several = part.chunk.min() != part.chunk.max()
    for lo in range(0, n, TILE):
        for to in range(lo, n, TILE):
            a, b = slice(lo, min(n, lo + TILE)), slice(to, min(n, to + TILE))
            common = np.zeros((a.stop - lo, b.stop - to), np.uint8)
            early = np.zeros_like(common)
            for w in range(4):
                common += np.bitwise_count(part.sets[a, None, w] & part.sets[None, b, w])
                if below[w]:
                    early += np.bitwise_count((prefix[a, None, w] & below[w]) & prefix[None, b, w])
            hit = (common >= shared) & (early == size)
            if lo == to:
                hit &= np.triu(np.ones(hit.shape, bool), 1)
            if several:  # pairs inside a chunk are met in that chunk's own part
                hit &= part.chunk[a, None] != part.chunk[None, b]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            if len(i) * 8 < hit.size:
                cosine = np.einsum("ij,ij->i", part.units[a][i], part.units[b][j])
            else:
                cosine = (part.units[a] @ part.units[b].T)[i, j]
            near = cosine >= bound - CLOSE
            i, j, cosine = i[near] + lo, j[near] + to, cosine[near]
            for k in np.flatnonzero(cosine <= bound + CLOSE).tolist():
                cosine[k] = part.x[i[k]] @ part.x[j[k]] / (part.norm[i[k]] * part.norm[j[k]])
            near = cosine >= bound
            i, j = i[near], j[near]
            links += np.bincount(i, part.copies[j], n).astype(np.int64) + np.bincount(j, part.copies[i], n).astype(np.int64)
            x, y = _span(i, j, n)
            left.append(x)
            right.append(y)
    if not left:
        return links, links[:0], links[:0]
    return links, *_span(np.concatenate(left), np.concatenate(right), n)


def _prefix_sets(sets: np.ndarray, width: int) -> np.ndarray:
    """The `width` lowest bits of each set."""
    rest, out = sets.copy(), np.zeros_like(sets)
    for _ in range(width):
        free = np.ones(len(sets), bool)
        for w in range(4):
            own = rest[:, w]
            low = np.where(free, own & (~own + np.uint64(1)), np.uint64(0))
            out[:, w] |= low
            rest[:, w] ^= low
            free &= low == 0
    return out


def _finder(pivots: dict[int, int], size: int, bound: float):
    """Links and edges from partitions that are sorted by list and part: a part may go on in the next batch."""
    names = ("label", "dim", "key", "part")

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, dim = t["key"][0].as_py(), t["dim"][0].as_py()
        shared = needed(pivots[dim])
        own = min(size, shared)
        width = min(NEAREST, pivots[dim]) - shared + own
        part = _Part(t, dim)
        links, a, b = _meet(part, key % 256, shared, own, width, bound)
        with_links = np.flatnonzero(links)
        if len(with_links):
            nodes = pa.array(part.nodes, pa.binary())
            rows = pa.concat_arrays([nodes.take(pa.array(with_links)), nodes.take(pa.array(a))])
            ends = pa.concat_arrays([pa.nulls(len(with_links), pa.binary()), nodes.take(pa.array(b))])
            yield pa.RecordBatch.from_arrays([rows, ends, pa.array(np.concatenate((links[with_links], np.zeros(len(a), np.int64))))], ["a", "b", "links"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            marks = list(zip(*(t[c].to_pylist() for c in names)))
            start = 0
            for k in range(1, len(marks)):
                if marks[k] != marks[start]:
                    if k - start > 1:
                        yield from found(t.slice(start, k - start))
                    start = k
            rest = t.slice(start).combine_chunks()
        if rest is not None and rest.num_rows > 1:
            yield from found(rest)

    return each


def lists_of(n: int, pivots: int) -> int:
    """Pivots in a key for lists of about LIST nodes, if the pivots that occur are alike."""
    shared, size = needed(pivots), 1
    width = min(NEAREST, pivots) - shared

    def mean(s: int) -> float:
        choices = keys = 1.0
        for k in range(s):
            choices *= (width + s - k) / (k + 1)
            keys *= (pivots - k) / (k + 1)
        return n * choices / keys

    while size < shared and mean(size) > LIST:
        size += 1
    return size


def links(nodes: DataFrame, bound: float) -> DataFrame:
    """(a, b, links): rows with b null hold links of node a (to be summed), others an edge of a spanning forest.

    nodes: node (binary), label (string, not null), copies, vector (array of doubles, usable), staged.
    """
    sample = nodes.orderBy("node").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    pivots = {dim: chosen(x) for dim, _, x in _vectors(sample)} if len(sample) else {}
    dims = {r["dim"]: r["n"] for r in nodes.groupBy(F.size("vector").alias("dim"), "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()}
    for dim in dims.keys() - pivots.keys():  # a length that the sample missed has pivots of its own
        own = nodes.filter(F.size("vector") == dim).orderBy("node").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
        pivots[dim] = chosen(_vectors(own)[0][2])
    rank = {dim: np.arange(len(p)) for dim, p in pivots.items()}
    counted = {(r["dim"], r["pivot"]): r["n"] for r in pivot_counts(nodes, pivots).collect()}  # PIVOTS rows a length
    for dim, p in pivots.items():
        order = sorted(range(len(p)), key=lambda k: (counted.get((dim, k), 0), k))
        rank[dim] = np.argsort(np.array(order))
    size = max((lists_of(n, len(pivots[dim])) for dim, n in dims.items()), default=1)
    rows, keys = (postings(nodes, pivots, rank, size, only) for only in (False, True))
    by = ["label", "dim", "key"]
    chunk = F.least(F.lit(MOST), F.greatest(F.lit(CHUNK), F.ceil(F.col("n") / MEETINGS)))
    sizes = staged(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by, F.ceil(F.col("n") / chunk).cast("int").alias("m")))
    rows = rows.join(sizes, by).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    meetings: Column = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.least("chunk", k) * F.col("m") + F.greatest("chunk", k))
    rows = rows.select(*by, F.explode(meetings).alias("part"), "chunk", "node", "copies", "vector", "pivots")
    dealt = rows.repartition(*by, "part").sortWithinPartitions(*by, "part", "node")
    return dealt.mapInArrow(_finder({d: len(p) for d, p in pivots.items()}, size, bound), "a binary, b binary, links bigint")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", bound: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df, linked with rows of its label at a cosine of bound or more.

    n_links counts rows, copies included; component_id is the smallest id reachable, the row's own included; kept rows
    are those whose id that is. Rows whose label is null, or whose vector is null, zero, or holds null or non-finite
    components, link with nothing; neither do vectors of different lengths. Rows without id link like others and take the id of their
    group, null if it has none. Repeated rows are copies of each other. An empty table gives no rows. Other columns are
    not read. Found are pairs that share SHARED of their NEAREST pivots.
    """
    v = F.col("vector")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    digest = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "label", "vector")), 16, "0") for k in (1, 2)]))
    rows = rows.withColumn("node", F.when(usable, digest))
    with scratch(df.sparkSession) as keep:
        nodes = staged(rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")))
        found = staged(links(nodes, bound))
        counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        tree = components(found.filter("b IS NOT NULL").select("a", "b"))
        grown = nodes.select("node", "least", "copies").join(counts, "node", "left").join(tree, "node", "left")
        grown = grown.filter("copies > 1 OR links IS NOT NULL").select("node", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
        grown = staged(grown)
        least = grown.groupBy("root").agg(F.min("least").alias("component"))
        to = staged(grown.join(least, "root").select(F.col("node").alias("node_"), (F.col("copies") - 1 + F.col("links")).alias("n"), "component"))
        keep(to)
    out = rows.select("vec_id", "node").join(to, F.col("node") == F.col("node_"), "left")
    component = F.when(F.col("node_").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
