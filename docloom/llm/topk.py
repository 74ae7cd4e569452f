"""Exact top-k by integer inner product: columnar branch and bound.

A candidate block is laid out vertically (one row of memory for each dimension). Inner products are accumulated one
block of dimensions at a time; what the remaining dimensions can still add is at most |rest of query| * |rest of
candidate| (Cauchy-Schwarz). Candidates whose accumulated product plus that mass stays below the k-th best so far are
dropped, and the survivors are compacted before the next block of dimensions is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import blocks

#: Dimensions in a block, queries that share a pass over it, candidates scored in full to start the bound.
DIMS, BATCH, SEED_ROWS = 16, 32, 1024
_LONG = np.iinfo(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, ties to the smaller id."""
    if len(places) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        scores, places = scores[keep], places[keep]
    return np.lexsort((ids[places], -scores))[:k], scores, places


def search(scale: int, k: int):
    """The search of blocks.nearest for floor(scale * x)."""

    def found(dim: int, ids: np.ndarray, vectors: np.ndarray, code: bytes, q_ids: np.ndarray, q_vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c, q = np.floor(vectors * scale), np.floor(q_vectors * scale)
        top = max(1.0, np.abs(c).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) * max(dim, 1)
        if top >= 2**53:
            yield from _wide(c, q, ids, q_ids, k)
            return
        kind = np.float32 if top < 2**24 else np.float64  # sums of integers below these are exact
        spread = np.argsort(-np.square(c, dtype=np.float64).sum(0), kind="stable")
        c, q = np.ascontiguousarray(c.T[spread]).astype(kind), q[:, spread].astype(kind)
        cuts = list(range(0, dim, DIMS)) or [0]
        mass_c = [np.sqrt(np.square(c[d + DIMS :], dtype=np.float64).sum(0)) for d in cuts]
        mass_q = [np.sqrt(np.square(q[:, d + DIMS :], dtype=np.float64).sum(1)) for d in cuts]
        for at in range(0, len(q), BATCH):
            batch = q[at : at + BATCH]
            own = q_ids[at : at + BATCH, None]
            seeds = np.where(ids[:SEED_ROWS] == own, -np.inf, batch @ c[:, :SEED_ROWS])
            floor = np.partition(seeds, -k, axis=1)[:, -k] if seeds.shape[1] >= k else np.full(len(batch), -np.inf)
            first = batch[:, : cuts[0] + DIMS] @ c[: cuts[0] + DIMS]
            for j in range(len(batch)):
                slack = 1e-9 * top + 0.5
                places = np.flatnonzero((first[j] + mass_q[0][at + j] * mass_c[0] >= floor[j] - slack) & (ids != q_ids[at + j]))
                partial = first[j, places].astype(np.float64)
                for n, d in enumerate(cuts[1:], 1):
                    partial += batch[j, d : d + DIMS] @ c[d : d + DIMS, places]
                    alive = partial + mass_q[n][at + j] * mass_c[n][places] >= floor[j] - slack
                    places, partial = places[alive], partial[alive]
                order, partial, places = _best(partial, ids, places, k)
                yield places[order], partial[order].astype(np.int64)

    return found


def _wide(c: np.ndarray, q: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Components beyond what floats add exactly: Python's integers; a score beyond a long is the nearest long."""
    exact = [[int(v) for v in row] for row in c]
    for own, row in zip(q_ids, q):
        ints = [int(v) for v in row]
        scored = sorted((-min(max(sum(map(int.__mul__, ints, x)), _LONG.min), _LONG.max), int(i), p) for p, (x, i) in enumerate(zip(exact, ids)) if i != own)[:k]
        yield np.array([s[2] for s in scored], np.int64), np.array([-s[0] for s in scored], np.int64)


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best rows of other ids.

    Components are floor(scale * x), the score is their integer inner product, ties go to the smaller id. Rows whose id
    or vector is null, or whose vector holds a null or non-finite component, take no part. Vectors meet vectors of
    their own length; those without components score 0. Repeated rows are candidates one by one and one query together.
    A score beyond the range of a long is held at its end. An empty table gives no rows. Other columns are not read.
    """
    rows = blocks.usable(df, id_col, vector_col, zero=True)
    return blocks.nearest(rows, rows.filter(F.col("id") % every == 0), search(scale, k), k, "bigint", lambda s: s.desc())
