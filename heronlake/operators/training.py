"""Labelled (query, document) pairs from judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of one block of the ring of documents that `negatives` walks.
BLOCK = 1024
#: Sides of ids and numbers are broadcast up to this many rows, and shuffled beyond.
BROADCAST_ROWS = 1_000_000


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that have judgements."""
    return queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def positives(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, label 1) where the grade is exactly 1 and both sides exist."""
    pairs = qrels.filter("rel = 1").join(queries, "query_id", "left_semi").join(docs, "doc_id", "left_semi")
    return pairs.select("query_id", "doc_id", F.lit(1).alias("label"))


def negative_candidates(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """All (query_id, doc_id) without a judgement. Grows as queries times documents: see `negatives`."""
    pairs = queries.select("query_id").crossJoin(docs.select("doc_id"))
    return pairs.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def _hash(*parts: Column | str) -> Column:
    """MD5 in hexadecimal digits of the parts joined by colons: an order that any engine can follow."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))


def _small(side: DataFrame, rows: DataFrame) -> DataFrame:
    """`side`, broadcast if `rows`, whose number bounds its own, are few."""
    return F.broadcast(side) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def negatives(qrels: DataFrame, queries: DataFrame, docs: DataFrame, ratio: int = 10, seed: int = 1, digits: int = 3) -> DataFrame:
    """`ratio` negatives per positive of each query, or all candidates where there are fewer, without forming all pairs.

    Documents have a place in one order, that of the MD5 of seed and id, counted within the ranges of its first `digits`
    digits. Each query walks the order, as a ring, from a place of its own: over as many documents as it wants negatives
    and has judgements, at most all of them. What is not judged of these is enough; the first so many are its negatives.
    The ring lies in blocks of BLOCK places, and walks are cut at them: a walk and the judgements on it meet as one row per
    block, and only the negatives themselves are spread out into rows.
    """
    judged = qrels.join(queries, "query_id", "left_semi").select("query_id", "doc_id", "rel")
    wanted = judged.groupBy("query_id").agg((F.count_if(F.col("rel") == 1) * ratio).alias("n"), F.count("*").alias("n_judged")).filter("n > 0")
    dealt = docs.select("doc_id").distinct().withColumn("h", _hash(str(seed), F.col("doc_id"))).withColumn("slot", F.substring("h", 1, digits))
    sizes = dealt.groupBy("slot").agg(F.count("*").alias("size"))
    starts = sizes.select("slot", F.expr("sum(size) over (order by slot) - size").alias("start"))  # at most 16 ** digits rows
    nth = F.expr("row_number() over (partition by slot order by h, doc_id) - 1")
    places = dealt.withColumn("nth", nth).join(F.broadcast(starts), "slot").select((F.col("start") + F.col("nth")).alias("place"), "doc_id")
    ring = places.groupBy(F.expr(f"place div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "doc_id")))["doc_id"].alias("ids"))
    walks = wanted.crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("n_docs"))))
    own = F.conv(F.substring(_hash(f"q{seed}", F.col("query_id")), 1, 12), 16, 10).cast("long")
    walks = walks.select("query_id", "n", "n_docs", F.pmod(own, F.col("n_docs")).alias("first"), F.least("n_docs", F.col("n") + F.col("n_judged")).alias("length"))
    # a walk past the end of the ring goes on at its start, as a second stretch
    end = F.col("first") + F.col("length")
    stretches = F.array(*[F.struct(F.lit(i).alias("stretch"), a.cast("long").alias("from"), b.alias("to")) for i, (a, b) in enumerate([(F.col("first"), F.least(end, "n_docs")), (F.lit(0), end - F.col("n_docs"))])])
    steps = walks.select("query_id", "n", F.inline(stretches)).filter("from < to")
    steps = steps.select("query_id", "n", "stretch", "from", "to", F.explode(F.expr(f"sequence(from div {BLOCK}, (to - 1) div {BLOCK})")).alias("block"))
    at = F.col("block") * BLOCK
    steps = steps.select("query_id", "n", "stretch", "block", F.greatest(F.col("from") - at, F.lit(0)).cast("int").alias("lo"), F.least(F.col("to") - at, F.lit(BLOCK)).cast("int").alias("hi"))
    met = judged.select("query_id", "doc_id").join(_small(places, docs), "doc_id").join(_small(walks, queries), "query_id")
    met = met.filter(F.pmod(F.col("place") - F.col("first"), F.col("n_docs")) < F.col("length"))
    met = met.groupBy("query_id", (F.col("place") < F.col("first")).cast("int").alias("stretch"), F.expr(f"place div {BLOCK}").alias("block"))
    steps = steps.join(met.agg(F.array_distinct(F.collect_list("doc_id")).alias("judged")), ["query_id", "stretch", "block"], "left")
    left = F.col("hi") - F.col("lo") - F.when(F.col("judged").isNull(), 0).otherwise(F.size("judged"))
    steps = steps.withColumn("left", left).withColumn("ahead", F.expr("sum(left) over (partition by query_id order by stretch, block) - left")).filter("ahead < n")
    some = F.slice("ids", F.col("lo") + 1, F.col("hi") - F.col("lo"))
    some = F.when(F.col("judged").isNull(), some).otherwise(F.array_except(some, "judged"))
    taken = F.slice(some, F.lit(1), F.least(F.col("n") - F.col("ahead"), F.lit(BLOCK)).cast("int"))
    pairs = steps.join(_small(ring, docs), "block").select("query_id", F.explode(taken).alias("doc_id"))
    return pairs.select("query_id", "doc_id", F.lit(0).alias("label"))


def examples(qrels: DataFrame, queries: DataFrame, docs: DataFrame, ratio: int = 10, seed: int = 1) -> DataFrame:
    """(query_id, doc_id, label, query_text, doc_text): positives and sampled negatives."""
    pairs = positives(qrels, queries, docs).unionByName(negatives(qrels, queries, docs, ratio, seed))
    return pairs.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id").join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id")


def limited(rows: DataFrame, positive_limit: int = 2000, negative_limit: int = 20_000, seed: int = 1) -> DataFrame:
    """At most so many examples of each label, the first by MD5 of seed and ids."""
    order = [_hash(f"l{seed}", F.col("query_id"), F.col("doc_id")), F.col("query_id"), F.col("doc_id")]
    return rows.filter("label = 1").orderBy(*order).limit(positive_limit).unionByName(rows.filter("label = 0").orderBy(*order).limit(negative_limit))


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"))
