"""Batches of boolean AND/OR queries ranked by BM25."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.functions.text import DIGITS, query_tokens
from heronlake.operators import adding
from heronlake.operators.index import Index

K1, B = 1.2, 0.75
#: Up to so many distinct query terms are pushed down to the postings' scan; more are joined.
PUSHED_TERMS = 10_000
MODES = {"0": "and", "and": "and", "conjunctive": "and", "1": "or", "or": "or", "disjunctive": "or"}


def mode_of(mode: str | int) -> str:
    """`and` or `or` from any accepted spelling."""
    found = MODES.get(str(mode).strip().lower())
    if found is None:
        raise ValueError(f"unknown mode {mode!r}")
    return found


def term_score(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    """BM25 of one term; negative for terms in over half of the documents."""
    norm = K1 * ((1 - B) + B * length / average)
    return F.log((n - df + 0.5) / (df + 0.5)) * (K1 + 1) * tf / (norm + tf)


def query_terms(queries: DataFrame, canonical: bool = True, underscore: bool = True) -> DataFrame:
    """(query_id, term, qtf, n_terms) of queries(query_id, text); queries without terms have no rows."""
    terms = queries.select("query_id", F.explode(query_tokens(F.col("text"), canonical, underscore)).alias("term"))
    counts = terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return counts.withColumn("n_terms", F.expr("count(*) over (partition by query_id)"))


def _for_terms(table: DataFrame, terms: DataFrame, pushed: list[str] | None) -> DataFrame:
    """The table's rows of the terms: by a filter that reaches the scan, or by a join."""
    if pushed is not None:
        return table.filter(F.col("term").isin(pushed))
    return table.join(terms.select("term").distinct(), "term", "left_semi")


def _weights(terms: DataFrame, index: Index, length: str, floor_average: bool) -> DataFrame:
    """(term, doc_id, weight): each posting of the terms is read and weighed once, however many queries ask for it."""
    columns = {"words": ("word_count", "avg_words"), "bytes": ("data_length", "avg_bytes")}
    own, average = columns[length]
    some = [r.term for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    few = len(some) <= PUSHED_TERMS
    pushed = some if few else None
    df = _for_terms(index.lexicon, terms, pushed).select("term", "df")
    hits = _for_terms(index.postings, terms, pushed).select("term", "doc_id", "tf", own).join(F.broadcast(df) if few else df, "term")
    hits = hits.crossJoin(F.broadcast(index.corpus()))  # one row
    mean = F.floor(average) if floor_average else F.col(average)
    return hits.select("term", "doc_id", term_score(F.col("tf"), F.col("df"), F.col("n_docs"), F.col(own), mean).alias("weight"))


def _few(terms: DataFrame) -> bool:
    return terms.limit(10 * PUSHED_TERMS + 1).count() <= 10 * PUSHED_TERMS


def score(queries: DataFrame, index: Index, mode: str | int = "or", length: str = "words", floor_average: bool = False, canonical: bool = True) -> DataFrame:
    """(query_id, doc_id, score) of all matches; only the postings of the batch's terms are read."""
    terms = query_terms(queries, canonical)
    weights, asked = _weights(terms, index, length, floor_average), _few(terms)
    parts = weights.join(F.broadcast(terms) if asked else terms, "term").select("query_id", "doc_id", "n_terms", (F.col("qtf") * F.col("weight")).alias("part"))
    found = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"), F.count("*").alias("matched"), F.max("n_terms").alias("n_terms"))
    if mode_of(mode) == "and":
        found = found.filter("matched = n_terms")
    return found.select("query_id", "doc_id", "score")


def top_k(scored: DataFrame, k: int, descending_ids: bool = False) -> DataFrame:
    """Adds rank from 1 and keeps the first k per query; ties by doc_id."""
    order = "score desc, doc_id desc" if descending_ids else "score desc, doc_id"
    return scored.withColumn("rank", F.expr(f"row_number() over (partition by query_id order by {order})")).filter(F.col("rank") <= k)


def _best(terms: DataFrame, weights: DataFrame, k: int, every: bool) -> DataFrame:
    """(query_id, doc_id, score): each task's best k of each query; a document's weights lie together, and no row is formed for a query and a document.

    The terms, at most 10 * PUSHED_TERMS rows, go to the tasks with the function.
    """
    asked = terms.toArrow().combine_chunks()
    kinds = T.StructType([terms.schema["query_id"], weights.schema["doc_id"], T.StructField("score", T.DoubleType())])
    if not asked.num_rows:
        return terms.sparkSession.createDataFrame([], kinds)
    column = lambda name: asked[name].combine_chunks()
    ids = pc.unique(column("query_id"))
    own = np.asarray(pc.index_in(column("query_id"), ids))
    n_terms = np.zeros(len(ids), dtype=np.int64)
    n_terms[own] = np.asarray(column("n_terms"))
    known = adding.Queries(column("term"), own, np.asarray(column("qtf")), n_terms)

    def run(batches):
        first = next(batches, None)
        if first is not None:
            query, docs, value = known.best(itertools.chain([first], batches), k, every, first["doc_id"].type)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), docs, pa.array(value)], ["query_id", "doc_id", "score"])

    lists = weights.groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight")).alias("p"))
    rows = lists.select("doc_id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))
    return rows.mapInArrow(run, kinds).withColumn("score", F.round("score", DIGITS))


def search(
    queries: DataFrame, index: Index, mode: str | int = "or", k: int = 20, docs: DataFrame | None = None, length: str = "words",
    floor_average: bool = False, canonical: bool = True,
) -> DataFrame:
    """Top k per query; with `docs` also their text, fetched for the hits alone."""
    terms = query_terms(queries, canonical)
    if _few(terms):
        found = top_k(_best(terms, _weights(terms, index, length, floor_average), k, mode_of(mode) == "and"), k)
    else:
        found = top_k(score(queries, index, mode, length, floor_average, canonical), k)
    if docs is not None:
        found = found.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    return found


def search_text(spark, index: Index, text: str, mode: str | int = "or", k: int = 20, docs: DataFrame | None = None) -> DataFrame:
    """One query given as text, as a console or a form would send it."""
    if not text.strip():
        raise ValueError("empty query")
    return search(spark.createDataFrame([(0, text)], "query_id long, text string"), index, mode, k, docs).orderBy("rank")


def search_line(spark, index: Index, line: str, k: int = 20, docs: DataFrame | None = None) -> DataFrame:
    """A query as it comes over the wire: `text|mode`, the mode after the last bar."""
    text, bar, mode = line.rstrip("\r\n").rpartition("|")
    if not bar:
        raise ValueError("no mode in the line")
    return search_text(spark, index, text, mode, k, docs)
