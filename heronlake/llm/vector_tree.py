"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample and every vector is put into a leaf. A query opens
nodes by a priority queue, largest inner product with the node's mean first. How many
leaves to visit is calibrated: a bounded set of queries is also searched in all leaves, and
visits are widened until its mean recall reaches the aim.

Leaves are searched in blocks: neighbouring small leaves share a block, and a leaf of more
vectors than a block holds is split. A query goes only to the blocks of the leaves that it
visits, once to each. Where very many queries visit a block, they are searched in tiles, so a
task holds a bounded number of vectors and of queries. Equal vectors are searched as one,
with their k + 1 smallest ids, which are all that can be among the k nearest. Scores are
sums over the dimensions in order, in double precision, on the original vectors, so ties
are exact.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do those whose length isn't the most frequent one (the smaller one of equals); rows
with a null id take no part. A query's own row alone is no candidate of it: other rows with its
id are. Where rows of one id divisible by the step hold different vectors, the least vector
(component by component) asks. Fewer candidates than k give fewer rows, and an empty table
none. Columns other than vec_id and embedding are ignored, whatever their names are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm import worker
from heronlake.llm.sides import bounded
from heronlake.session import cut_lineage

#: Vectors that the tree is fitted on and queries that calibrate it, at most.
SAMPLE, CALIBRATION = 50_000, 200
BRANCHES, LEAF_ROWS, LEAST_SAMPLE_LEAF = 8, 128, 8
#: Vectors of a block, at least and at most, and queries of a tile, at most about.
BLOCK_ROWS, TILE_ROWS = (1024, 32_768), 32_768
#: Mean recall aimed at on the calibration queries.
AIM = 0.96

_FOUND = "query_id long, vec_id long, score double, leaf long"


@dataclass
class Tree:
    """Nodes by number; children of leaves are empty. `leaf` numbers the leaves, neighbours next to each other."""

    means: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: dict[int, int] = field(default_factory=dict)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Each vector's leaf: the nearest child at every level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            m = np.array([self.means[c] for c in self.children[node]])
            near = np.argmin((m * m).sum(1) - 2 * (x[rows] @ m.T), axis=1)
            todo += [(c, rows[near == i]) for i, c in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> Iterator[list[int]]:
        """For each query the first `most` leaves, best bin first."""
        m = np.array(self.means)
        for at in range(0, len(q), 512):
            for score in q[at : at + 512] @ m.T:
                queue, leaves = [(0.0, 0)], []
                while queue and len(leaves) < most:
                    node = heapq.heappop(queue)[1]
                    if not self.children[node]:
                        leaves.append(self.leaf[node])
                    for c in self.children[node]:
                        heapq.heappush(queue, (-score[c], c))
                yield leaves


def fit_tree(x: np.ndarray, leaf_size: int, seed: int = 11) -> Tree:
    """Split by k-means into BRANCHES until a node holds at most `leaf_size` of the sample."""
    tree, rng = Tree([x.mean(0) if len(x) else np.zeros(1)], [[]]), np.random.default_rng(seed)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        parts = _split(x[rows], rng) if len(rows) > leaf_size else []
        if len(parts) < 2:
            tree.leaf[node] = len(tree.leaf)
            continue
        for p in parts:
            tree.children[node].append(len(tree.means))
            todo.append((len(tree.means), rows[p]))
            tree.means.append(x[rows[p]].mean(0))
            tree.children.append([])
    return tree


def _split(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    m = x[rng.choice(len(x), min(BRANCHES, len(x)), replace=False)]
    for _ in range(8):
        near = np.argmin((m * m).sum(1) - 2 * (x @ m.T), axis=1)
        m = np.array([x[near == i].mean(0) if (near == i).any() else m[i] for i in range(len(m))])
    return [p for i in range(len(m)) if len(p := np.flatnonzero(near == i))]


def blocks_of(counts: dict[int, int], n_leaves: int, rows: int) -> tuple[list[int], list[int]]:
    """For each leaf its first block and its number of blocks: neighbours of at most `rows` vectors in all share one."""
    first, n_blocks, block, used = [], [], -1, rows + 1
    for leaf in range(n_leaves):
        n = counts.get(leaf, 0)
        parts = max(1, -(-n // rows))
        if used + n > rows:
            block, used = block + 1, 0
        first.append(block)
        n_blocks.append(parts)
        block += parts - 1
        used = rows if parts > 1 else used + n
    return first, n_blocks


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _search_block(k: int):
    """Top k of one block for the queries that visit it."""

    def one(x: np.ndarray, leaf: np.ndarray, ids: list, spans: dict, part: pa.Table) -> tuple[np.ndarray, ...]:
        q, own = _matrix(part.column("embedding")), part.column("query_id").to_numpy()
        score = np.full((len(q), len(x)), -np.inf)
        by_leaf: dict[int, list[int]] = {}
        for i, leaves in enumerate(part.column("leaves").to_pylist()):
            for v in spans if leaves is None else leaves:
                by_leaf.setdefault(v, []).append(i)
        for v, rows in by_leaf.items():
            if v in spans:
                a, b = spans[v]
                score[rows, a:b] = q[rows] @ x[a:b].T
        # one more: a query's own vector may be among them; 1e-9 covers the order of summation
        kth = np.partition(score, -(k + 1), axis=1)[:, -(k + 1)] if len(x) > k else np.full(len(q), -np.inf)
        margin = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
        rows, cols = np.nonzero((score >= (kth - margin)[:, None]) & np.isfinite(score))
        exact = np.zeros(len(rows))
        for d in range(x.shape[1]):
            exact += q[rows, d] * x[cols, d]
        n = np.array([len(ids[c]) for c in cols], np.int64)
        r, c = np.repeat(rows, n), np.repeat(cols, n)
        found = np.concatenate([ids[c] for c in cols]).astype(np.int64) if len(cols) else np.zeros(0, np.int64)
        exact = np.repeat(exact, n)
        # the query's own row: the first of its id among the copies of its own vector
        mine = np.flatnonzero(own[r] == found)
        mine = mine[(q[r[mine]] == x[c[mine]]).all(axis=1)]
        keep = np.ones(len(r), bool)
        keep[mine[np.unique(r[mine], return_index=True)[1]]] = False
        r, c, found, exact = r[keep], c[keep], found[keep], exact[keep]
        order = np.lexsort((found, -exact, r))
        r, c, found, exact = r[order], c[order], found[order], exact[order]
        starts = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1)) if len(r) else np.zeros(0, np.int64)
        place = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
        top = place < k
        return own[r[top]], found[top], exact[top], leaf[c[top]]

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        worker.forget("vector_tree")
        out = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_by("leaf")
            x, leaf, ids = _matrix(vectors.column("embedding")), vectors.column("leaf").to_numpy(), vectors.column("ids").to_pylist()
            names, begins = np.unique(leaf, return_index=True)
            spans = dict(zip(names.tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(leaf)], strict=True), strict=True))
            step = max(1, min(128, (4 << 20) // len(x)))  # a matrix of scores of at most 32 MB
            out = [one(x, leaf, ids, spans, queries.slice(at, step)) for at in range(0, len(queries), step)]
        types = (np.int64, np.int64, np.float64, np.int64)
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate(types)]
        return pa.table(columns, names=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def _usable(table: DataFrame) -> DataFrame:
    fine = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(f"vec_id is not null and coalesce({fine}, false)")
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (sizes.n if sizes else 0))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


class Index:
    """A fitted tree and the vectors in its leaves, searched for any number of queries."""

    def __init__(self, rows: DataFrame, k: int, sample: int = SAMPLE):
        """rows: vec_id, embedding (as from `_usable`)."""
        place = F.expr("row_number() over (partition by embedding order by vec_id)")
        copies = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
        points = cut_lineage(copies.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
        self.k, self.n = k, points.count()
        share = F.pmod(F.xxhash64("embedding"), F.lit(1_000_000))
        some = points.filter(share < math.ceil(1_000_000 * min(1.0, 0.95 * sample / max(self.n, 1))))
        drawn = some.select(F.array_min("ids").alias("first"), "embedding").limit(sample).toArrow().sort_by("first")
        x = _matrix(drawn.column("embedding"))[: len(drawn)]
        self.tree = tree = fit_tree(x, max(LEAST_SAMPLE_LEAF, math.ceil(LEAF_ROWS * len(x) / max(self.n, 1))))

        def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker.forget("vector_tree")
            for b in batches:
                if b.num_rows:
                    yield b.append_column("leaf", pa.array(tree.assign(_matrix(b.column("embedding")))))

        spread = cut_lineage(points.mapInArrow(leaves_of, "embedding array<double>, ids array<bigint>, leaf long"))
        counts = {r.leaf: r["count"] for r in spread.groupBy("leaf").count().collect()}  # one row per leaf: at most sample / 8
        tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
        self.first, self.n_blocks = blocks_of(counts, len(tree.leaf), min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], math.ceil(self.n / tasks))))
        table = rows.sparkSession.createDataFrame([(v, a, n) for v, (a, n) in enumerate(zip(self.first, self.n_blocks, strict=True))], "leaf long, first long, n_blocks long")
        spread = spread.join(F.broadcast(table), "leaf")  # at most sample / 8 rows of 24 bytes
        self.vectors = spread.select("embedding", "ids", "leaf", (F.col("first") + F.pmod(F.xxhash64("ids"), F.col("n_blocks"))).alias("block"))

    def asked(self, queries: DataFrame, visits: int | None) -> DataFrame:
        """(query_id, embedding, block, leaves): each query once for each block of its first `visits` leaves; None: of all."""
        tree, first, n_blocks = self.tree, self.first, self.n_blocks

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker.forget("vector_tree")
            for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                rows, blocks, leaves = [], [], []
                for i, seen in enumerate(tree.visits(_matrix(b.column("embedding")), len(first) if visits is None else visits)):
                    by: dict[int, list[int]] = {}
                    for v in seen:
                        for block in range(first[v], first[v] + n_blocks[v]):
                            by.setdefault(block, []).append(v)
                    for block, own in by.items():
                        rows.append(i), blocks.append(block), leaves.append(None if visits is None else own)
                part = b.select(["query_id", "embedding"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blocks, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["query_id", "embedding", "block", "leaves"])

        return queries.mapInArrow(ask, "query_id long, embedding array<double>, block long, leaves array<long>")

    def found(self, asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score, leaf): the k nearest in each block that a query visits."""
        asked = cut_lineage(asked)
        tiles = asked.groupBy("block").agg(F.ceil(F.count("*") / TILE_ROWS).cast("long").alias("n_tiles"))
        tiles = bounded(cut_lineage(tiles))
        left = self.vectors.join(tiles, "block").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1))).drop("n_tiles")
        right = asked.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("query_id"), F.col("n_tiles"))).drop("n_tiles")
        return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(_search_block(self.k), _FOUND)

    def calibrated(self, queries: DataFrame, aim: float) -> int:
        """The fewest leaves whose visit finds the share `aim` of the true neighbours of at most CALIBRATION queries."""
        total = queries.count()
        share = F.pmod(F.xxhash64("query_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, 0.9 * CALIBRATION / max(total, 1)))
        few = cut_lineage(queries.filter(share).limit(CALIBRATION))
        truth = _best(self.found(self.asked(few, None)), self.k).select("query_id", "leaf").collect()  # CALIBRATION * k rows at most
        own: dict[int, list[int]] = {}
        for r in truth:
            own.setdefault(r.query_id, []).append(r.leaf)
        drawn = few.toArrow()
        nth = []
        for query, visits in zip(drawn.column("query_id").to_pylist(), self.tree.visits(_matrix(drawn.column("embedding")), len(self.first)), strict=False):
            place = {v: i + 1 for i, v in enumerate(visits)}
            nth += [place[v] for v in own.get(query, [])]
        if not nth:
            return len(self.first)
        return int(np.sort(nth)[min(len(nth) - 1, math.ceil(aim * len(nth)) - 1)])


def search(table: DataFrame, k: int = 20, query_step: int = 20, aim: float = AIM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest of each row whose id is divisible by `query_step`."""
    rows = _usable(table)
    index = Index(rows, k)
    queries = rows.filter(F.pmod(F.col("vec_id"), F.lit(query_step)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    queries = cut_lineage(queries)
    found = index.found(index.asked(queries, index.calibrated(queries, aim)))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
