"""A stated query set against all rows, in blocks.

Candidates are dealt into blocks of bounded size; each block meets every block of queries in one task, which streams the
query blocks past the candidate block it holds. What is moved is the candidates once and the queries once for each
candidate block. Nothing is broadcast and a task holds one candidate block and one query block.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a block of candidates (least and most) and of queries; fewer where their vectors would take more bytes.
LEAST, MOST, QUERIES = 8192, 65536, 2048
#: Bytes of the vectors of a block of candidates and of queries.
BYTES, QUERY_BYTES = 1 << 25, 1 << 22


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id, vector) of the rows that take part: id and vector not null, components neither null nor non-finite.

    zero: whether vectors of zeros (and those without components) take part.
    """
    v = F.col("vector")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, bad))
    return rows if zero else rows.filter(F.exists(v, lambda x: x != 0))


def _packed(batches: Iterator[pa.RecordBatch], encode: Callable[[np.ndarray], bytes] | None, rows: int, size: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(dimensions, ids, vectors, code) in blocks of at most so many rows and bytes of vectors, which are float64, row by row."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(dim: int) -> tuple[int, bytes, bytes, bytes]:
        parts = held.pop(dim)
        x = np.concatenate([p[1] for p in parts])
        return dim, np.concatenate([p[0] for p in parts]).tobytes(), x.tobytes(), encode(x) if encode else b""

    for b in batches:
        ids, vectors = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
        dims = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            x = flat.reshape(-1, dim) if len(own) == len(dims) and dim else flat[np.repeat(dims == dim, dims)].reshape(len(own), dim)
            most = max(1, min(rows, size // (8 * max(dim, 1))))
            for k in range(0, len(own), most):
                if dim in held and sum(len(p[0]) for p in held[dim]) + min(most, len(own) - k) > most:
                    yield out(dim)
                held.setdefault(dim, []).append((ids[own[k : k + most]], x[k : k + most]))
    for dim in list(held):
        yield out(dim)


_ROW = "block int, kind int, dim int, ids binary, vectors binary, code binary"


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    search: Callable[[int, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]],
    k: int,
    score_type: str,
    order: Callable[[Column], Column],
    encode: Callable[[np.ndarray], bytes] | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what search gives, ties to the smaller id.

    search(dim, ids, vectors, code, query_ids, query_vectors) yields for each query, in their order, the places of
    candidates in the block and their scores: at least the block's k best among them, own id left out.
    A vector meets vectors of its own length only. Query rows alike in id and vector count once.
    """
    n, values = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector").cast("bigint")), F.lit(0))).collect()[0]
    parts = max(1, -(-n // min(MOST, max(LEAST, n // 64))), -(-8 * values // BYTES))

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        for dim, ids, x, code in _packed(batches, encode, MOST, 2 * BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([dim], pa.int32()), *[pa.array([v], pa.binary()) for v in (ids, x, code)]], ["block", "kind", "dim", "ids", "vectors", "code"])

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, x, _ in _packed(batches, None, QUERIES, QUERY_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([1], pa.int32()), pa.array([dim], pa.int32()), *[pa.array([v], pa.binary()) for v in (ids, x, b"")]], ["block", "kind", "dim", "ids", "vectors", "code"])

    asked = queries.dropDuplicates(["id", "vector"]).coalesce(max(1, parts // 8)).mapInArrow(pack_queries, _ROW)
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"), "kind", "dim", "ids", "vectors", "code")
    dealt = rows.repartition(parts).mapInArrow(pack_rows, _ROW).unionByName(asked)
    score_pa = pa.float64() if score_type == "double" else pa.int64()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = -1, {}
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                x = np.frombuffer(r["vectors"], np.float64).reshape(len(ids), r["dim"])
                if r["block"] != block:
                    block, own = r["block"], {}
                if r["kind"] == 0:
                    own.setdefault(r["dim"], []).append((ids, x, r["code"]))
                    continue
                for c_ids, c, code in own.get(r["dim"], []):
                    q_out, v_out, s_out, h_out = [], [], [], []
                    for q, (places, scores) in enumerate(search(r["dim"], c_ids, c, code, ids, x)):
                        q_out.append(np.full(len(places), ids[q]))
                        h_out.append(np.full(len(places), struct.unpack("<q", struct.pack("<Q", _print(x[q])))[0]))
                        v_out.append(c_ids[places])
                        s_out.append(scores)
                    if q_out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q_out), pa.int64()), pa.array(np.concatenate(h_out), pa.int64()), pa.array(np.concatenate(v_out), pa.int64()), pa.array(np.concatenate(s_out), score_pa)], ["query_id", "query_print", "vec_id", "score"])

    met = dealt.repartitionById(parts, F.col("block")).sortWithinPartitions("block", "kind").mapInArrow(meet, f"query_id bigint, query_print bigint, vec_id bigint, score {score_type}")
    by = Window.partitionBy("query_id", "query_print").orderBy(order(F.col("score")), "vec_id")
    return met.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _print(x: np.ndarray) -> int:
    """Tells apart query rows that share an id but not a vector."""
    import xxhash

    return xxhash.xxh64_intdigest(x.tobytes(), 0)
