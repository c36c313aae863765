"""Two-stage ranking, and hooks for encoders and pair scorers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions.text import DIGITS, index_tokens, with_prefix
from heronlake.functions.vectors import dot
from heronlake.operators.bm25 import top_k


#: Words of the model-free encoder: what stands between ASCII white space.
_WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def hashed_encoder(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """A model-free encoder: signed hashed words, unit length."""

    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in _WORDS.findall((text or "").lower()):
                h = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4])
                v[h % dim] += 1 if h & (1 << 31) else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return encode


def encode(rows: DataFrame, text: str = "text", kind: str | None = "passage", encoder: Callable | None = None) -> DataFrame:
    """Adds `embedding`; `encoder` maps a batch (pandas Series) of texts to vectors."""
    run = F.pandas_udf(encoder or hashed_encoder(), "array<double>")
    value = F.coalesce(F.col(text), F.lit("")) if kind is None else with_prefix(F.col(text), kind)
    return rows.withColumn("embedding", run(value))


def overlap(query: Column, doc: Column) -> Column:
    """A model-free pair scorer: share of the query's distinct tokens that the document has."""
    q = F.array_distinct(index_tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, index_tokens(doc))) / F.size(q)).otherwise(F.lit(0.0))


def rerank_dense(run: DataFrame, queries: DataFrame, corpus: DataFrame, first: int = 300, last: int = 100) -> DataFrame:
    """The first `first` of each query's run by inner product; candidates without a vector are left out."""
    heads = run.filter(F.col("rank") <= first).select("query_id", "doc_id")
    pairs = heads.join(corpus.select("doc_id", "embedding"), "doc_id").join(queries.select("query_id", "vector"), "query_id")
    return top_k(pairs.select("query_id", "doc_id", F.round(dot(F.col("vector"), F.col("embedding")), DIGITS).alias("score")), last)


def missing_vectors(run: DataFrame, corpus: DataFrame) -> DataFrame:
    return run.join(corpus.select("doc_id"), "doc_id", "left_anti")


def rerank_pairs(
    run: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Callable[[Column, Column], Column] = overlap, first: int = 300, last: int = 100
) -> DataFrame:
    """The first `first` of each query's run by a pair scorer (columns in, column out; a pandas UDF is one)."""
    heads = run.filter(F.col("rank") <= first).select("query_id", "doc_id")
    pairs = heads.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id").join(
        queries.select("query_id", F.col("text").alias("query_text")), "query_id"
    )
    value = scorer(F.coalesce("query_text", F.lit("")), F.coalesce("doc_text", F.lit("")))
    return top_k(pairs.select("query_id", "doc_id", F.round(value, DIGITS).alias("score")), last)
