"""Readers of document collections, queries and vectors, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) with `line_no`, which ascends in file order: by file, then by the line's place in it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("nth"))
    return rows.select("value", F.struct("file", "nth").alias("line_no"))


def read_passages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents(doc_id, text), rejected(value)) of `id \\t text` lines, split at the first tab."""
    return parse_passages(spark.read.text(path))


def parse_passages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of lines(value)."""
    two = F.split("value", "\t", 2)
    number = F.trim(two[0])
    good = (F.size(two) == 2) & number.rlike("^[0-9]+$") & number.try_cast("long").isNotNull()
    docs = lines.filter(good).select(number.cast("long").alias("doc_id"), two[1].alias("text"))
    return docs, lines.filter(~good)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, position) of one id per line; position is the row of a matching vector file."""
    rows = spark.read.text(path).select(
        F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")
    ).filter(F.col("value").rlike("^[0-9]+$"))
    # parts of one file ascend as its lines do; one row per file and part is summed up
    parts = rows.groupBy("file", "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("ahead", F.expr("coalesce(sum(n) over (order by file, part rows between unbounded preceding and 1 preceding), 0)"))
    own = F.expr("row_number() over (partition by file, part order by nth) - 1")
    placed = rows.withColumn("own", own).join(F.broadcast(parts), ["file", "part"])
    return placed.select(F.col("value").cast("long").alias("doc_id"), (F.col("ahead") + F.col("own")).cast("long").alias("position"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of tab-separated lines with two fields at least."""
    two = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(two) >= 2).select(two[0].alias("query_id"), two[1].alias("text"))


def read_query_ids(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, first_line): distinct ids, to be ordered by their first line."""
    ids = numbered(spark, path).select(F.split("value", "\t")[0].alias("query_id"), "line_no")
    return ids.filter("query_id <> ''").groupBy("query_id").agg(F.min("line_no").alias("first_line"))


def read_jsonl(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(`key`, text) of JSON lines with _id and text; missing text is empty."""
    rows = spark.read.schema("_id string, text string").json(path).filter("_id is not null")
    return rows.select(F.col("_id").alias(key), F.coalesce("text", F.lit("")).alias("text"))


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment table with header."""
    names = ["Dataset", "Bi-Encoder", "Cross-Encoder", "Fine-Tuned", "MAP", "MRR", "NDCG@10", "NDCG@30", "Recall@10", "Recall@30"]
    schema = ", ".join(f"`{n}` {'string' if i < 4 else 'double'}" for i, n in enumerate(names))
    return spark.read.schema(schema).csv(path, header=True)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding array<float>) of Parquet."""
    return spark.read.schema("id string, embedding array<float>").parquet(path)


def convert_npy(spark: SparkSession, array_path: str, ids: list, out: str, rows: int = 10_000) -> None:
    """Write a NumPy matrix as vector Parquet, `rows` at a time; ids in row order. Runs where the file is."""
    import numpy as np

    matrix = np.load(array_path, mmap_mode="r")
    if len(ids) != len(matrix):
        raise ValueError(f"{len(ids)} ids for {len(matrix)} vectors")
    for at in range(0, len(matrix), rows):
        part = [(str(i), v.tolist()) for i, v in zip(ids[at : at + rows], matrix[at : at + rows], strict=True)]
        spark.createDataFrame(part, "id string, embedding array<float>").write.mode("append").parquet(out)


def convert_hdf5(spark: SparkSession, path: str, out: str, ids: str | list = "id", vectors: str = "embedding", rows: int = 10_000) -> None:
    """Write an HDF5 file's vectors as Parquet; needs h5py. `ids`: the data set that holds them, or they themselves in row
    order (for files of `embeddings` and `shape` alone)."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py") from e
    with h5py.File(path) as f:
        for at in range(0, len(f[vectors]), rows):
            own = (f[ids] if isinstance(ids, str) else ids)[at : at + rows]
            names = [x.decode() if isinstance(x, bytes) else str(x) for x in own]
            part = list(zip(names, (v.tolist() for v in f[vectors][at : at + rows]), strict=True))
            spark.createDataFrame(part, "id string, embedding array<float>").write.mode("append").parquet(out)
