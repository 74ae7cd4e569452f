"""Approximate nearest neighbours by score-aware (anisotropic) quantisation and four-bit table scans.

Euclidean nearness is a maximum inner product: |q - x|^2 = |q|^2 - 2 (q.x - |x|^2 / 2). The inner product is estimated
from codes of four bits for each pair of dimensions; |x|^2 / 2 is kept exactly. Codebooks and codes minimise a loss
that weighs the part of the residual that is parallel to the vector more than the rest, since that part moves the
scores of the vectors that matter. A scan adds table entries
for two codes at a time; its best candidates are ranked by exact distances on the original vectors, and then the others
that are likely to be nearer than the k-th of those. An estimate is off by the query times the candidate's residual,
about |q| |r| / sqrt(dimensions); what is left out would have to be off by over ``DEVIATIONS`` times that. Groups of near
copies, whose estimates are alike, are thus ranked whole. Without deviations the bound is |q| |r| and the search exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import blocks

#: Rows that codebooks are fitted on at most, dimensions to a code, its centres, rounds of fitting and of encoding.
SAMPLE, WIDTH, CENTRES, ROUNDS, PASSES = 20_000, 2, 16, 8, 2
#: Rows that are encoded together.
ENCODED = 4096
#: Inner products below this share of |x| do not count as worth finding; it sets the weight of the parallel residual.
THRESHOLD = 0.2
#: Candidates of a block that are ranked first for each query; their k-th distance bounds which others are ranked too.
RERANK = 64
#: How many times the usual error an estimate may be off before a candidate that it rules out is missed.
DEVIATIONS = 3.0


class Codebooks:
    """For vectors of one length: centres (codes, CENTRES, WIDTH)."""

    def __init__(self, x: np.ndarray, seed: int = 7, threshold: float = THRESHOLD):
        self.dim = x.shape[1]
        parts = self._split(x)
        rng = np.random.default_rng(seed)
        self.parallel = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        pick = rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)
        self.centres = parts[pick].transpose(1, 0, 2).copy() + rng.normal(0, 1e-9, (parts.shape[1], CENTRES, WIDTH))
        for _ in range(ROUNDS):
            self._fit(parts, np.concatenate([self.encode(x[k : k + ENCODED]) for k in range(0, len(x), ENCODED)], 1))

    def _split(self, x: np.ndarray) -> np.ndarray:
        """(rows, codes, WIDTH), padded by zeros."""
        wide = -(-x.shape[1] // WIDTH) * WIDTH
        return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), -1, WIDTH)

    def _units(self, parts: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.square(parts).sum((1, 2)))
        return parts / np.where(norm > 0, norm, 1)[:, None, None]

    def _fit(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """Best centres for the codes, one code at a time: a small linear system for each centre."""
        units = self._units(parts)
        held = np.stack([self.centres[m, codes[m]] for m in range(len(codes))], 1)
        along = ((parts - held) * units).sum(2)
        for m, own in enumerate(codes):
            rest = along.sum(1) - along[:, m]
            u, x = units[:, m], parts[:, m]
            extra = self.parallel - 1
            a = np.zeros((CENTRES, WIDTH, WIDTH))
            b = np.zeros((CENTRES, WIDTH))
            np.add.at(a, own, np.eye(WIDTH) + extra * u[:, :, None] * u[:, None, :])
            np.add.at(b, own, x + extra * u * ((u * x).sum(1) + rest)[:, None])
            used = np.bincount(own, minlength=CENTRES) > 0
            self.centres[m, used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
            along[:, m] = ((x - self.centres[m, own]) * u).sum(1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(codes, rows) of uint8 below CENTRES: nearest centres first, then passes over the codes by the whole loss."""
        parts = self._split(x)
        units = self._units(parts)
        apart = np.stack([np.square(parts[:, m, None] - self.centres[m]).sum(2) for m in range(parts.shape[1])], 1)
        lean = np.stack([(units[:, m] * parts[:, m]).sum(1)[:, None] - units[:, m] @ self.centres[m].T for m in range(parts.shape[1])], 1)
        codes = apart.argmin(2)
        rows = np.arange(len(x))
        total = np.take_along_axis(lean, codes[:, :, None], 2).sum((1, 2))
        for _ in range(PASSES):
            for m in range(parts.shape[1]):
                rest = total - lean[rows, m, codes[:, m]]
                codes[:, m] = (apart[:, m] + (self.parallel - 1) * np.square(rest[:, None] + lean[:, m])).argmin(1)
                total = rest + lean[rows, m, codes[:, m]]
        return np.ascontiguousarray(codes.T.astype(np.uint8))

    def packed(self, x: np.ndarray) -> bytes:
        """Two codes to a byte, (pairs, rows)."""
        pieces = []
        for k in range(0, len(x), ENCODED):
            codes = self.encode(x[k : k + ENCODED])
            if len(codes) % 2:
                codes = np.concatenate((codes, np.zeros_like(codes[:1])))
            pieces.append(codes[::2] | codes[1::2] << 4)
        return np.concatenate(pieces, 1).tobytes()

    def residuals(self, x: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """The length of what each row's codes leave of it."""
        parts, square = self._split(x), np.zeros(len(x))
        for m in range(parts.shape[1]):
            codes = packed[m // 2] >> 4 if m % 2 else packed[m // 2] & 15
            square += np.square(parts[:, m] - self.centres[m, codes]).sum(1)
        return np.sqrt(square)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, pairs, 256): inner products of a query with both halves of a byte."""
        products = np.einsum("qmw,mcw->qmc", self._split(q), self.centres)
        if products.shape[1] % 2:
            products = np.concatenate((products, np.zeros_like(products[:, :1])), 1)
        return (products[:, 1::2, :, None] + products[:, ::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def _open(estimate: np.ndarray, off: np.ndarray, slack: float, vectors: np.ndarray, q: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places whose estimate, off by up to |q| times off, may lie above the k-th best score of the first ones."""
    square = q @ q
    cut = (square - np.partition(np.square(vectors[first] - q).sum(1), k - 1)[k - 1]) / 2
    return np.flatnonzero(estimate + np.sqrt(square) * off >= cut - slack)


def search(books: dict[int, Codebooks], k: int, rerank: int, deviations: float | None = DEVIATIONS):
    """The search of blocks.nearest; a length without codebooks is searched exactly, and so are all without deviations."""

    def found(dim: int, ids: np.ndarray, vectors: np.ndarray, code: bytes, q_ids: np.ndarray, q_vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        half = np.square(vectors).sum(1) / 2
        book = books.get(dim)
        codes = np.frombuffer(code, np.uint8).reshape(-1, len(ids)) if book else None
        scanned = book and len(ids) > rerank + 1
        if scanned:
            off = book.residuals(vectors, codes)
            longest = float((np.sqrt(2 * half) + off).max())
            off *= 1 if deviations is None else min(1.0, deviations / np.sqrt(dim))
        for at in range(0, len(q_ids), 64):
            tables = book.tables(q_vectors[at : at + 64]) if scanned else None
            for j, own in enumerate(q_ids[at : at + 64]):
                q, places = q_vectors[at + j], np.arange(len(ids))
                if scanned:
                    estimate = -half
                    for table, column in zip(tables[j], codes):
                        estimate += table[column]
                    first = np.argpartition(-estimate, rerank)[: rerank + 1]
                    first = first[ids[first] != own]
                    if len(first) >= k:
                        length = np.linalg.norm(q)
                        # Tables hold single precision; the slack is far above their rounding.
                        slack = 1e-6 * (length * longest + length**2 + longest**2)
                        places = np.union1d(first, _open(estimate, off, slack, vectors, q, first, k))
                places = places[ids[places] != own]
                exact = np.sqrt(np.square(vectors[places] - q).sum(1))
                order = np.lexsort((ids[places], exact))[:k]
                yield places[order], exact[order]

    return found


def neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, sample: int = SAMPLE, rerank: int = RERANK, deviations: float | None = DEVIATIONS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k nearest found, ids differing.

    Codebooks are fitted on at most `sample` rows, those of the smallest hashes of their ids; every row is encoded and
    scanned. deviations: see DEVIATIONS; None searches exactly. score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id.
    Rows whose id or vector is null, zero, or with null or non-finite components take no part. Vectors meet vectors of
    their own length. Repeated rows are candidates one by one and one query together. An empty table gives no rows.
    """
    rows = blocks.usable(df, id_col, vector_col, zero=False)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    dims = np.diff(drawn.offsets.to_numpy()) if len(drawn) else np.zeros(0, np.int64)
    flat = drawn.flatten().to_numpy(zero_copy_only=False).astype(np.float64) if len(drawn) else np.zeros(0)
    by = {dim: flat[np.repeat(dims == dim, dims)].reshape(-1, dim) for dim in np.unique(dims).tolist()}
    books = {dim: Codebooks(v) for dim, v in by.items()}
    encode = lambda x: books[x.shape[1]].packed(x) if x.shape[1] in books else b""
    return blocks.nearest(rows, rows.filter(F.col("id") % every == 0), search(books, k, rerank, deviations), k, "double", lambda s: s.asc(), encode)
