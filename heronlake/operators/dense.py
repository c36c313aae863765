"""Dense retrieval: exact top-k over array columns, and a saved index of hashed vectors."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.functions.text import DIGITS
from heronlake.functions.vectors import dot, inverse_distance, squared_l2
from heronlake.operators import nearest
from heronlake.operators.bm25 import top_k
from heronlake.session import cut_lineage

#: Queries are broadcast up to this many rows; larger sets go through in about that many rows at a time.
BROADCAST_QUERIES = 10_000
#: Rows of one batch that a task hands on.
OUT_ROWS = 1 << 16
#: Hash tables, bits of a bucket's number, and bits in which a query's buckets may differ from its own.
TABLES, BITS, PROBES = 16, 6, 1


def _value(metric: str) -> Column:
    distance = squared_l2(F.col("q"), F.col("embedding"))
    value = {"dot": dot(F.col("q"), F.col("embedding")), "l2": -distance, "inverse": inverse_distance(distance)}[metric]
    return F.round(value, DIGITS)


def exact_scores(queries: DataFrame, corpus: DataFrame, metric: str = "dot") -> DataFrame:
    """(query_id, doc_id, score) for queries(query_id, vector) against corpus(doc_id, embedding).

    metric: dot, l2 (negated, so more is nearer) or inverse (1 / squared distance).
    """
    rows = queries.select("query_id", F.col("vector").alias("q"))
    return corpus.select("doc_id", "embedding").crossJoin(F.broadcast(rows)).select("query_id", "doc_id", _value(metric).alias("score"))


def _regular(vector: str, dim: int) -> Column:
    """Whether a vector has `dim` components, all of them numbers whose products are finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) <= 1e100))
    return F.coalesce((F.size(vector) == dim) & sound, F.lit(False))


def _slices(queries: DataFrame) -> list[DataFrame]:
    """The queries in parts, by hash, of about BROADCAST_QUERIES rows."""
    n = max(1, math.ceil(queries.count() / BROADCAST_QUERIES))
    return [queries] if n == 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def _dim(queries: DataFrame) -> int:
    one = queries.select(F.size("vector").alias("n")).filter("n > 0").first()
    return one.n if one else 0


def _in_blocks(queries: DataFrame, corpus: DataFrame, k: int, metric: str, dim: int, normals: np.ndarray | None = None) -> DataFrame:
    """(query_id, doc_id, score): of regular vectors, each task's best k of each query; no pairs are formed outside a block.

    The queries, at most about BROADCAST_QUERIES, go to the tasks with the function; each task reads its share of the corpus once.
    """
    rows = queries.filter(_regular("vector", dim)).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = rows.toArrow().combine_chunks()
    corpus = corpus.filter(_regular("embedding", dim)).repartition("doc_id")
    kinds = T.StructType([rows.schema["query_id"], corpus.schema["doc_id"], T.StructField("score", T.DoubleType())])
    if not asked.num_rows:
        return queries.sparkSession.createDataFrame([], kinds)
    ids, asked_vectors = asked["query_id"].combine_chunks(), nearest.matrix(asked["vector"].combine_chunks())
    near = np.array([x.bit_count() <= PROBES for x in range(1 << BITS)])
    own = None if normals is None else nearest.hashes(asked_vectors, normals).astype(np.uint16)

    def run(batches):
        def parts():
            for b in nearest.chunks(batches):
                buckets = None if own is None else nearest.matrix(b["buckets"]).astype(np.uint16)
                yield b["doc_id"], nearest.matrix(b["embedding"]), buckets

        first = next(batches, None)
        if first is not None:
            batches = itertools.chain([first], batches)
            found, docs, score = nearest.Search(asked_vectors, k, metric, own, near).best(parts(), first["doc_id"].type)
            names = [f.name for f in kinds]
            for at in range(0, len(found), OUT_ROWS):
                cut = slice(at, at + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(found[cut])), docs.slice(at, OUT_ROWS), pa.array(score[cut])], names)

    return corpus.mapInArrow(run, kinds).withColumn("score", F.round("score", DIGITS))


def exact_top_k(queries: DataFrame, corpus: DataFrame, k: int = 100, metric: str = "dot") -> DataFrame:
    """Top k by exact score. Vectors with missing, vast or too few components are scored one by one, and may score null."""
    found, dim = None, _dim(queries)
    corpus = corpus.select("doc_id", "embedding")
    odd = corpus.filter(~_regular("embedding", dim))
    for part in _slices(queries.select("query_id", "vector")):
        rows = _in_blocks(part, corpus, k, metric, dim)
        rows = rows.unionByName(exact_scores(part, odd, metric))
        others = part.filter(~_regular("vector", dim))
        if not others.isEmpty():
            rows = rows.unionByName(exact_scores(others, corpus.filter(_regular("embedding", dim)), metric))
        best = top_k(rows, k)
        found = best if found is None else found.unionByName(best)
    return found


def planes(dim: int, tables: int = TABLES, bits: int = BITS) -> list[list[list[float]]]:
    """Normals of hyperplanes, one for each bit of each table, from a fixed rule that any engine can follow."""

    def draw(i: int) -> float:
        x = i + 1
        for _ in range(3):
            x = (x * 1664525 + 1013904223) % (1 << 32)
            x ^= x >> 15
        return x / (1 << 31) - 1

    return [[[draw((t * bits + b) * dim + d) for d in range(dim)] for b in range(bits)] for t in range(tables)]


def buckets(vector: Column, normals: list[list[list[float]]]) -> Column:
    """Array of a vector's bucket in each table: a bit is set where the vector is on the plane's positive side."""
    tables = F.array(*[F.array(*[F.array(*map(F.lit, v)) for v in table]) for table in normals])
    side = lambda normal, i: F.when(dot(vector, normal) > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)
    return F.transform(tables, lambda table: F.aggregate(F.transform(table, side), F.lit(0), lambda s, x: s + x))


@dataclass(frozen=True)
class HashedIndex:
    """vectors(doc_id, embedding, buckets): the bucket of each vector in each table; `dim`: length of the vectors."""

    vectors: DataFrame
    dim: int

    @staticmethod
    def build(corpus: DataFrame) -> HashedIndex:
        """corpus: doc_id, embedding; the first vector tells `dim`."""
        rows = corpus.filter("embedding is not null").select("doc_id", "embedding")
        one = rows.select(F.size("embedding").alias("n")).first()
        dim = one.n if one else 0
        normals = np.array(planes(dim)).reshape(TABLES, BITS, dim)

        def hashed(batches):
            for b in nearest.chunks(batches):
                own = nearest.hashes(nearest.matrix(b["embedding"]), normals)
                yield b.append_column("buckets", pa.FixedSizeListArray.from_arrays(pa.array(own.reshape(-1)), TABLES).cast(pa.list_(pa.int32())))

        kinds = T.StructType([*rows.schema.fields, T.StructField("buckets", T.ArrayType(T.IntegerType()))])
        whole = rows.filter(_regular("embedding", dim)).mapInArrow(hashed, kinds)
        odd = rows.filter(~_regular("embedding", dim)).withColumn("buckets", buckets(F.col("embedding"), planes(dim)))
        return HashedIndex(whole.unionByName(odd), dim)

    def save(self, path: str) -> HashedIndex:
        """Written once, read by any number of searches."""
        self.vectors.write.parquet(f"{path}/vectors")
        return HashedIndex.load(self.vectors.sparkSession, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> HashedIndex:
        vectors = spark.read.parquet(f"{path}/vectors")
        one = vectors.select(F.size("embedding").alias("n")).first()
        return HashedIndex(vectors, one.n if one else 0)

    def _pairs(self, queries: DataFrame, rows: DataFrame, metric: str) -> DataFrame:
        """(query_id, doc_id, score) of odd vectors: those in a bucket that differs from the query's in PROBES bits at most, in any table."""
        near = [x for x in range(1 << BITS) if x.bit_count() <= PROBES]
        asked = queries.select("query_id", F.posexplode(buckets(F.col("vector"), planes(self.dim))).alias("table", "own"))
        asked = asked.select("query_id", "table", F.explode(F.transform(F.array(*map(F.lit, near)), lambda x: F.col("own").bitwiseXOR(x))).alias("bucket"))
        pairs = asked.join(rows.select("doc_id", F.posexplode("buckets").alias("table", "bucket")), ["table", "bucket"]).select("query_id", "doc_id").distinct()
        pairs = pairs.join(rows, "doc_id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
        return pairs.select("query_id", "doc_id", _value(metric).alias("score"))

    def search(self, queries: DataFrame, k: int = 100, metric: str = "dot") -> DataFrame:
        """Top k by exact score of the vectors in a bucket that differs from the query's in PROBES bits at most, in any table.

        Queries with fewer than k of these are searched exactly.
        """
        queries, sound = queries.select("query_id", "vector"), _regular("embedding", self.dim)
        normals = np.array(planes(self.dim)).reshape(TABLES, BITS, self.dim)
        found = None
        for part in _slices(queries):
            rows = _in_blocks(part, self.vectors, k, metric, self.dim, normals).unionByName(self._pairs(part, self.vectors.filter(~sound), metric))
            others = part.filter(~_regular("vector", self.dim))
            if not others.isEmpty():
                rows = rows.unionByName(self._pairs(others, self.vectors.filter(sound), metric))
            best = top_k(rows, k)
            found = best if found is None else found.unionByName(best)
        found = cut_lineage(found)  # at most k rows a query, read three times
        full = found.filter(F.col("rank") == k).select("query_id")
        short = queries.join(full, "query_id", "left_anti")
        found = found.join(full, "query_id", "left_semi")
        return found if short.isEmpty() else found.unionByName(exact_top_k(short, self.vectors, k, metric))


def hashed_top_k(queries: DataFrame, corpus: DataFrame, k: int = 100, metric: str = "dot") -> DataFrame:
    """Approximate top-k without a saved index."""
    return HashedIndex.build(corpus).search(queries, k, metric)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of `truth`'s (query_id, doc_id) that is found."""
    hits = truth.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hits.agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
