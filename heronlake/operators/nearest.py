"""The work of one task of a vector search, in NumPy: the best k of every query among the vectors that the task reads.

Products of whole blocks say which pairs may be among the best; only these are scored exactly, in double precision and in
the order of the dimensions, as `functions.vectors` does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from heronlake.functions.text import DIGITS

#: Queries and vectors of one block, and pairs that are scored at a time.
QUERY_ROWS, CORPUS_ROWS, PAIRS = 256, 8192, 1 << 16
_SCALE = 10**DIGITS


def rounded(x: np.ndarray) -> np.ndarray:
    """Half up at DIGITS decimals, as Spark's round: by the shortest decimal form where doubles can't tell."""
    scaled, small = np.abs(x) * _SCALE, np.abs(x) < 1 << 22
    out = np.where(small, np.copysign(np.floor(scaled + 0.5) / _SCALE, x), x)
    close = small & (np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-15 * scaled + 1e-12)
    step = Decimal(1).scaleb(-DIGITS)
    for i in np.flatnonzero(close):  # few
        out[i] = float(Decimal(repr(float(x[i]))).quantize(step, ROUND_HALF_UP))
    return out


def matrix(rows: pa.Array) -> np.ndarray:
    """Vectors of one length, without nulls, as a matrix of doubles."""
    return np.asarray(rows.flatten(), dtype=np.float64).reshape(len(rows), -1)


def hashes(vectors: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Each vector's bucket in each table, of normals[table, bit, dim]: sums in the order of the dimensions."""
    tables, bits, dim = normals.shape
    flat, sums = normals.reshape(-1, dim), np.zeros((len(vectors), tables * bits))
    for i in range(dim):
        sums += vectors[:, i : i + 1] * flat[None, :, i]
    return ((sums > 0).reshape(-1, tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)


def heads(query: np.ndarray, order: list[np.ndarray], k: int) -> np.ndarray:
    """Indices of each query's first k pairs in `order` (least important key first), queries ascending."""
    at = np.lexsort([*order, query])
    q = query[at]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) if len(q) else np.arange(0)
    return at[nth < k]


class Search:
    """metric: as in `dense`. With `buckets` (of the queries, by table) only pairs whose buckets are `near` in some table count."""

    def __init__(self, vectors: np.ndarray, k: int, metric: str, buckets: np.ndarray | None = None, near: np.ndarray | None = None):
        self.q, self.k, self.metric, self.buckets, self.near = vectors, k, metric, buckets, near
        self.by_dim, self.norms = np.ascontiguousarray(vectors.T), (vectors * vectors).sum(axis=1)

    def _exact(self, qi: np.ndarray, ci: np.ndarray, c_by_dim: np.ndarray) -> np.ndarray:
        out = np.zeros(len(qi))
        for at in range(0, len(qi), PAIRS):
            q, c, s = qi[at : at + PAIRS], ci[at : at + PAIRS], out[at : at + PAIRS]
            for x, y in zip(self.by_dim, c_by_dim, strict=True):
                step = x[q] * y[c] if self.metric == "dot" else x[q] - y[c]
                s += step if self.metric == "dot" else step * step
        if self.metric == "inverse":
            return np.where(out == 0, 1e9, 1 / np.where(out == 0, 1, out))
        return -out if self.metric == "l2" else out

    def _cut(self, score: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """The block value from which on a pair may reach a score."""
        score = score - 2 / _SCALE
        if self.metric == "inverse":
            return np.where(score > 0, -1 / np.where(score > 0, score, 1), -np.inf) - margin
        return score - margin

    def _reached(self, value: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """The score that pairs of a block value or more have at least."""
        if self.metric == "inverse":
            return np.minimum(1e9, 1 / np.maximum(margin - value, 1e-300))
        return value - margin

    def _is_near(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of buckets[..., table] of queries and vectors."""
        found = np.zeros(np.broadcast_shapes(q.shape, c.shape)[:-1], dtype=bool)
        for t in range(q.shape[-1]):
            found |= self.near[q[..., t] ^ c[..., t]]
        return found

    def _block(self, at: int, c: np.ndarray, c_by_dim: np.ndarray, c_norms: np.ndarray, buckets: np.ndarray | None, reached: np.ndarray):
        """(query, vector, score) of the pairs that may be among the best, at most k a query."""
        q, k = slice(at, at + QUERY_ROWS), self.k
        value = self.q[q] @ c.T
        scale = np.sqrt(self.norms[q] * c_norms.max())
        if self.metric != "dot":
            value *= 2
            value -= self.norms[q, None]
            value -= c_norms
            scale = self.norms[q] + c_norms.max()
        margin = 1e-13 * (16 + c.shape[1]) * scale
        cut = self._cut(reached[q], margin)
        maybe = value >= cut[:, None]
        many = np.flatnonzero(np.count_nonzero(maybe, axis=1) > 4 * k)
        if len(many):
            own = value[many]
            if buckets is not None:
                own = np.where(self._is_near(self.buckets[q][many][:, None], buckets[None]), own, -np.inf)
            kth = np.partition(own, len(c) - k, axis=1)[:, len(c) - k]
            least = np.where(kth == -np.inf, -np.inf, self._cut(self._reached(np.where(kth == -np.inf, 0, kth), margin[many]), margin[many]))
            maybe[many] = (own >= np.maximum(cut[many], least)[:, None]) & (own > -np.inf)
        qi, ci = np.nonzero(maybe)
        if buckets is not None:
            ok = self._is_near(self.buckets[q][qi], buckets[ci])
            qi, ci = qi[ok], ci[ok]
        qi = qi + at
        score = self._exact(qi, ci, c_by_dim)
        best = heads(qi, [ci, -rounded(score)], k)
        return qi[best], ci[best], score[best]

    def best(self, chunks: Iterable[tuple[pa.Array, np.ndarray, np.ndarray | None]], ids_type: pa.DataType) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(query's index, id, score) of each query's best k among chunks of (ids, vectors, buckets)."""
        query, score, ids = np.zeros(0, dtype=np.int64), np.zeros(0), pa.array([], ids_type)
        for own, c, buckets in chunks:
            order = pc.array_sort_indices(own, null_placement="at_start")
            own, c, buckets = own.take(order), c[np.asarray(order)], None if buckets is None else buckets[np.asarray(order)]
            full = np.bincount(query, minlength=len(self.q)) == self.k
            reached = np.full(len(self.q), -np.inf)
            np.minimum.at(kth := np.full(len(self.q), np.inf), query, rounded(score))
            reached[full] = kth[full]
            norms, by_dim = (c * c).sum(axis=1), np.ascontiguousarray(c.T)
            parts = [self._block(at, c, by_dim, norms, buckets, reached) for at in range(0, len(self.q), QUERY_ROWS)]
            qi, ci, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            query, score = np.r_[query, qi], np.r_[score, s]
            ids = pa.concat_arrays([ids, own.take(pa.array(ci))])
            places = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense"))
            kept = heads(query, [places, -rounded(score)], self.k)
            query, score, ids = query[kept], score[kept], ids.take(pa.array(kept))
        return query, ids, score


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of CORPUS_ROWS."""
    for batch in batches:
        for at in range(0, batch.num_rows, CORPUS_ROWS):
            yield batch.slice(at, CORPUS_ROWS)
