"""Ranking metrics per query and as means, without UDFs.

A document is relevant if its grade is 1 or more. Runs are ranked by score, ties by
doc_id descending, as trec_eval does; the file's own rank is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.session import cut_lineage

CUTS = (5, 10, 20, 30, 100)
#: Runs are broadcast up to this many rows of ids, and shuffled beyond.
BROADCAST_ROWS = 1_000_000


def _graded(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with rank and grade (unjudged: 0). Of the judgements only those of the run's documents are moved, if these are few."""
    ranked = cut_lineage(run).withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, doc_id desc)"))
    grades = qrels.select("query_id", "doc_id", "rel")
    if ranked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        grades = grades.join(F.broadcast(ranked.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_semi")
    return ranked.join(grades, ["query_id", "doc_id"], "left").fillna(0, ["rel"])


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run of queries that have judgements, with rank and grade (unjudged: 0)."""
    return _graded(run, qrels).join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def per_query(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """query_id, map, recip_rank, and p_k, recall_k, ndcg_k for each cut, of queries that have judgements."""
    rows = _graded(run, qrels)
    hit = F.col("rel") >= 1
    rows = rows.withColumn("hits", F.expr("sum(int(rel >= 1)) over (partition by query_id order by rank rows unbounded preceding)"))
    gain = lambda rel, rank: rel / F.log2(rank + 1.0)
    # judgements are counted by grade; only the first places of the ideal order are spread out
    grades = qrels.groupBy("query_id", "rel").agg(F.count("*").alias("n"))
    n = F.when(F.col("rel") > 0, F.col("n")).otherwise(0)
    ahead = F.expr("coalesce(sum(n) over (partition by query_id order by rel desc rows between unbounded preceding and 1 preceding), 0)")
    places = F.expr(f"sequence(ahead + 1, ahead + least(n, {max(cuts)} - ahead))")
    ideal = grades.withColumn("n", n).withColumn("ahead", ahead)
    ideal = ideal.select("query_id", "rel", "n", F.posexplode_outer(F.when((F.col("n") > 0) & (F.col("ahead") < max(cuts)), places)).alias("nth", "place"))
    ideal = ideal.groupBy("query_id").agg(
        F.nullif(F.sum(F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("n"))), F.lit(0)).alias("n_rel"),
        *[F.sum(F.when(F.col("place") <= k, gain(F.col("rel"), F.col("place")))).alias(f"ideal_{k}") for k in cuts],
    )
    found = rows.groupBy("query_id").agg(
        F.sum(F.when(hit, F.col("hits") / F.col("rank"))).alias("precisions"), F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        *[F.sum(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hits_{k}") for k in cuts],
        *[F.sum(F.when((F.col("rank") <= k) & (F.col("rel") > 0), gain(F.col("rel"), F.col("rank")))).alias(f"dcg_{k}") for k in cuts],
    )
    both = found.join(ideal, "query_id")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return both.select(
        "query_id", zero(F.col("precisions") / F.col("n_rel")).alias("map"), zero(1 / F.col("first_hit")).alias("recip_rank"),
        *[zero(F.col(f"hits_{k}") / k).alias(f"p_{k}") for k in cuts],
        *[zero(F.col(f"hits_{k}") / F.col("n_rel")).alias(f"recall_{k}") for k in cuts],
        *[zero(F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).alias(f"ndcg_{k}") for k in cuts],
    )


def means(metrics: DataFrame) -> DataFrame:
    """One row: the mean of each metric over its queries."""
    return metrics.agg(*[F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c != "query_id"])


def mrr(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mean reciprocal rank over all queries of the run, judged or not."""
    rows = _graded(run.withColumn("place", F.expr("row_number() over (partition by query_id order by score desc, doc_id)")), qrels)
    queries = rows.groupBy("query_id").agg(F.min(F.when(F.col("rel") > 0, F.col("place"))).alias("first"))
    return queries.agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def metrics_json(metrics: DataFrame) -> DataFrame:
    """Per query a JSON object of metrics with 4 decimals."""
    return metrics.select("query_id", F.to_json(F.struct(*[F.format_string("%.4f", F.col(c)).alias(c) for c in metrics.columns if c != "query_id"])).alias("metrics"))


def metric_pivot(table: DataFrame, metric: str, columns: list[str]) -> DataFrame:
    """Experiment rows (dataset, encoder, metrics) as a grid dataset x encoder; absent cells are null."""
    return table.groupBy("dataset").pivot("encoder", columns).agg(F.first(metric))


def pick(table: DataFrame, metric: str, **where: str) -> DataFrame:
    """A metric's values of the experiment rows that match; NaN if none does."""
    rows = table
    for name, value in where.items():
        rows = rows.filter(F.col(name) == value)
    return rows.agg(F.coalesce(F.first(metric), F.lit(float("nan"))).alias(metric))
