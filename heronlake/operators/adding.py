"""The work of one task of a BM25 search, in NumPy: weights of terms added up by query, and the best k documents kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from heronlake.operators.nearest import heads, rounded

#: Cells (documents times queries) of one block.
CELLS = 1 << 20


class Queries:
    """Which queries ask for a term, and how often: terms (sorted), and of term i the slice start[i]:start[i + 1] of query and count."""

    def __init__(self, terms: pa.Array, query: np.ndarray, count: np.ndarray, n_terms: np.ndarray):
        order = np.asarray(pc.array_sort_indices(terms))
        self.query, self.count, self.n_terms = query[order], count[order].astype(np.float64), n_terms
        self.terms = pc.unique(terms.take(pa.array(order)))
        sizes = np.bincount(np.asarray(pc.index_in(terms, self.terms)), minlength=len(self.terms))
        self.start = np.r_[0, np.cumsum(sizes)]

    def best(self, batches: Iterator[pa.RecordBatch], k: int, every: bool, ids_type: pa.DataType) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(query's index, doc_id, score) of each query's best k of rows (doc_id, terms, weights), one a document; `every`: all its terms must be there."""
        n = len(self.n_terms)
        query, score, ids = np.zeros(0, dtype=np.int64), np.zeros(0), pa.array([], ids_type)
        reached = np.full(n, -np.inf)
        rows = max(1, CELLS // n)
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            sizes = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            term = np.asarray(pc.index_in(batch["terms"].flatten(), self.terms))
            asked = self.start[term + 1] - self.start[term]
            at = np.arange(asked.sum()) + np.repeat(self.start[term] - np.r_[0, np.cumsum(asked)[:-1]], asked)
            cell = np.repeat(doc, asked) * n + self.query[at]
            total = np.bincount(cell, np.repeat(np.asarray(batch["weights"].flatten()), asked) * self.count[at], batch.num_rows * n).reshape(-1, n)
            matched = np.bincount(cell, minlength=batch.num_rows * n).reshape(-1, n)
            hit = matched == self.n_terms if every else matched > 0
            hit &= total >= reached
            di, qi = np.nonzero(hit)
            query, score = np.r_[query, qi], np.r_[score, total[di, qi]]
            ids = pa.concat_arrays([ids, batch["doc_id"].take(pa.array(di))])
            places = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense"))
            own = rounded(score)
            kept = heads(query, [places, -own], k)
            query, score, ids = query[kept], score[kept], ids.take(pa.array(kept))
            full = np.bincount(query, minlength=n) == k
            np.minimum.at(kth := np.full(n, np.inf), query, own[kept])
            reached[full] = kth[full] - 2e-9
        return query, ids, score
