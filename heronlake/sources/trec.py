"""Run and judgement files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.sources.collections import numbered

RUN = "query_id string, q0 string, doc_id string, rank int, score double, run_name string"
QRELS = "query_id string, placeholder string, doc_id string, rel int"


def _fields(lines: DataFrame, schema: str) -> DataFrame:
    """Tab-separated lines(value, line_no) as typed columns; a missing field is null."""
    parts = F.split("value", "\t")
    fields = [f.split() for f in schema.split(", ")]
    return lines.filter("value <> ''").select(*[F.get(parts, i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)], "line_no")


def _last(rows: DataFrame, value: str) -> DataFrame:
    """Of lines that repeat a (query, document) the last one holds."""
    return rows.groupBy("query_id", "doc_id").agg(F.max_by(value, "line_no").alias(value))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) of 4 tab-separated columns."""
    return _last(_fields(numbered(spark, path), QRELS), "rel")


def read_beir_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) of 3 columns under a header; blank lines are skipped."""
    three = F.split(F.trim("value"), r"\s+")
    rows = numbered(spark, path).filter((F.size(three) == 3) & three[2].rlike("^-?[0-9]+$"))
    return _last(rows.select(three[0].alias("query_id"), three[1].alias("doc_id"), three[2].cast("int").alias("rel"), "line_no"), "rel")


def read_run(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of 6 tab-separated columns; `first`: the first lines of each query, in file order."""
    rows = _fields(numbered(spark, path), RUN).select("query_id", "doc_id", "score", "rank", "line_no")
    if first is not None:
        rows = rows.withColumn("nth", F.expr("row_number() over (partition by query_id order by line_no)")).filter(F.col("nth") <= first)
    return rows.select("query_id", "doc_id", "score", "rank")


def run_rows(run: DataFrame, name: str) -> DataFrame:
    """The 6 columns of a run file."""
    return run.select("query_id", F.lit("Q0").alias("q0"), "doc_id", "rank", "score", F.lit(name).alias("run_name"))


def write_run(run: DataFrame, path: str, name: str) -> None:
    run_rows(run, name).sort("query_id", "rank").write.csv(path, sep="\t")
