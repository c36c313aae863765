"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.session import cut_lineage

#: Up to so many edges (8 MB) are joined up by one task; more are contracted in rounds.
SMALL = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = root.setdefault(x, x)
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "label"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of `edges(u, v)`: label is the least node of its component.

    A bounded number of edges is joined up by one task. Beyond, each round sends every node's larger neighbours, then its
    smaller ones, to its least neighbour, until nothing changes. A round moves as many rows as there are edges; nothing
    reaches the driver but a checksum. Loops and repeated edges are allowed; nodes are not null.
    """
    edges = cut_lineage(edges.select("u", "v"))
    if edges.limit(SMALL + 1).count() <= SMALL:
        return edges.coalesce(1).mapInArrow(_joined, "node long, label long")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut_lineage(e)
    before, after = None, _mark(e)
    while after != before:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        before, after = after, _mark(e)
    labels = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
