"""A corpus pipeline: language ID, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
`run` writes each stage's rows as Parquet to the shared folder and reads them again; a
stage's folder is removed as soon as the next one's is written, so only the last remains.

Defined cases, for all stages: any column may hold nulls; rows and doc_ids may repeat; texts
may be empty or very long and are worked on whole; an empty table stays empty; further
columns are kept by all stages but the last, whatever their names are, which ignores them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from heronlake.llm import exact_dedup, language_id, mixing, ngram_join, packing
from heronlake.session import use_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    Null, empty and letterless texts have none and go; a null source is a host of its own. Equal rows fare alike. Rows
    without a label in `lang` are not fitted on; without any labelled row nothing is kept.
    """
    return language_id.drop_unidentified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts.

    Null counts as empty. Among equal texts the least doc_id stays, a null one only if there is no other; of rows that
    repeat a doc_id and a text, one.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five words, 0.8).

    Null and blank texts are near to nothing and stay, as do rows whose doc_id is null. Rows of one doc_id are told
    apart by their texts; whole repeated rows of the least doc_id all stay.
    """
    return ngram_join.drop_near_copies(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.

    Texts without words are not taken; null sources are one source; rows that repeat a doc_id and a size share what they get.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences.

    A null text is empty: its closing id alone. Rows of one doc_id (such as a mix makes) and of none are packed each on its own.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Token ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_on(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages on `docs`."""
    use_checkpoint_dir(spark)
    context = spark.sparkContext
    folder = f"{context._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    last = None
    for nth, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{nth}-{name}"
        rows = stage(spark, docs, sf_dir)
        rows.write.parquet(here)
        docs = spark.read.schema(rows.schema).parquet(here)
        if last is not None:
            path = context._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        last = here
    return docs
