"""Exact dedup by content-defined chunk recipes.

A text is normalised (each run of ``[\\x20\\x09-\\x0D]`` becomes one space), cut into
content-defined chunks and described by its recipe: the ordered list of chunk
identifiers. A chunk identifier is a 128-bit digest plus the number of the byte string
among those that share the digest, so it stands for exactly one byte string; digests that
occur once need no comparison, and the bytes of the others move once per task and
distinct chunk. Texts are equal exactly when their recipes are equal, so documents are
grouped by recipes and their long texts never move.

Defined cases: null text counts as the empty text, whose recipe is the empty list; all
empty texts are one group. Of a group the smallest doc_id stays; null doc_ids sort last;
of rows that repeat a doc_id in one group exactly one is kept. Texts of any length are cut
into chunks of at most MOST bytes. An empty table gives an empty result. Other columns of
the input are ignored by `find_copies` and kept by `drop_copies`, whatever their names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm import worker
from heronlake.llm.sides import bounded, free_names, own
from heronlake.session import cut_lineage

#: Chunk sizes in bytes: at least, on average beyond that (a power of two), at most.
LEAST, MEAN_BITS, MOST = 1024, 11, 16384

_GEAR = np.random.default_rng(20240501).integers(0, 1 << MEAN_BITS, 256).astype(np.uint16)


def normalise(text: bytes) -> bytes:
    """Each run of space, tab, LF, VT, FF or CR becomes one space."""
    body = b" ".join(text.split())
    if not body:
        return b" " if text else b""
    return b" " * text[:1].isspace() + body + b" " * text[-1:].isspace()


def chunks(text: bytes) -> list[bytes]:
    """Cut where the gear hash of the last MEAN_BITS bytes is zero, within LEAST and MOST."""
    n = len(text)
    if n <= LEAST:
        return [text] if n else []
    gear = _GEAR[np.frombuffer(text, np.uint8)]
    rolled = gear.copy()
    for k in range(1, MEAN_BITS):
        rolled[k:] += gear[:-k] << k
    ends = np.flatnonzero((rolled & ((1 << MEAN_BITS) - 1)) == 0) + 1
    cuts, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > MOST:
            last += MOST
            cuts.append(last)
        if end - last >= LEAST or (end == n and end > last):
            last = end
            cuts.append(end)
    return [text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def _recipes(digest_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget("exact_dedup")
        for batch in worker.slices(batches, size=4 << 20):
            shas, lists = [], []
            for text in map(normalise, worker.texts(batch)):
                shas.append(hashlib.sha256(text).hexdigest())
                lists.append([hashlib.blake2b(c, digest_size=digest_size).digest() for c in chunks(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.binary()))],
                ["doc_id", "text_sha256", "digests"],
            )
        worker.give_back()

    return run


def _contents(digest_size: int, with_place: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget("exact_dedup")
        for batch in worker.slices(batches, size=4 << 20):
            docs, shas, places, digests, bodies = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), worker.texts(batch), strict=True):
                text = normalise(text)
                sha = hashlib.sha256(text).hexdigest() if with_place else None
                for place, chunk in enumerate(chunks(text)):
                    docs.append(doc), shas.append(sha), places.append(place)
                    digests.append(hashlib.blake2b(chunk, digest_size=digest_size).digest())
                    bodies.append(chunk)
            columns, names = [pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["digest", "body"]
            if with_place:
                columns += [pa.array(docs, pa.int64()), pa.array(shas, pa.string()), pa.array(places, pa.int32())]
                names += ["doc_id", "text_sha256", "place"]
            yield pa.RecordBatch.from_arrays(columns, names)
        worker.give_back()

    return run


def find_copies(docs: DataFrame, digest_size: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    recipes = docs.mapInArrow(_recipes(digest_size), "doc_id long, text_sha256 string, digests array<binary>")
    recipes = cut_lineage(recipes.withColumn("row_id", F.monotonically_increasing_id()))
    repeated = (
        recipes.select(F.explode("digests").alias("digest")).groupBy("digest").count().filter("count > 1").select("digest")
    )
    repeated = cut_lineage(repeated)
    bodies = docs.mapInArrow(_contents(digest_size, False), "digest binary, body binary").join(bounded(repeated), "digest", "left_semi").distinct()
    clashes = cut_lineage(bodies.groupBy("digest").count().filter("count > 1").select("digest"))
    recipes = recipes.withColumn("recipe", F.transform("digests", lambda d: F.struct(d.alias("digest"), F.lit(1).alias("variant"))))
    if not clashes.isEmpty():
        recipes = _numbered(docs, recipes, clashes, digest_size)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    groups = recipes.groupBy("recipe").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    groups = cut_lineage(groups)  # so that the join deals out both sides anew, and can split a large group
    return recipes.join(groups, "recipe").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        "text_sha256",
        F.size("digests").cast("long").alias("n_chunks"),
    )


def _numbered(docs: DataFrame, recipes: DataFrame, clashes: DataFrame, digest_size: int) -> DataFrame:
    """Recipes whose clashing digests carry the number of the chunk's byte string."""
    schema = "digest binary, body binary, doc_id long, text_sha256 string, place int"
    found = docs.mapInArrow(_contents(digest_size, True), schema).join(bounded(clashes), "digest", "left_semi")
    bodies = found.groupBy("digest", "body").count()
    numbers = bodies.select(
        "digest", "body", F.expr("row_number() over (partition by digest order by body)").alias("variant")
    )
    fixes = (
        found.join(numbers, ["digest", "body"])
        .groupBy("doc_id", "text_sha256")
        .agg(F.collect_set(F.struct("place", "variant")).alias("fixes"))
    )
    fixes = fixes.withColumn("fixes", F.map_from_entries("fixes"))
    other = fixes.select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"), "fixes")
    joined = recipes.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("s")), "left")
    numbered = F.transform(
        "recipe",
        lambda x, i: F.struct(x["digest"].alias("digest"), F.coalesce(F.try_element_at("fixes", i), F.lit(1)).alias("variant")),
    )
    return joined.withColumn("recipe", numbered).drop("d", "s", "fixes")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The input's rows and columns without the copies that `find_copies` rejects.

    Rows that agree in doc_id (null too) and normalised text are copies of one row: one is kept, chosen by a hash of
    all its columns. Only rows whose doc_id is null or repeated are told apart by their text; no other text moves.
    """
    found = cut_lineage(find_copies(docs))
    doc, sha, order, whole = free_names(docs, "copy_id", "copy_sha", "copy_order", "copy_row")
    repeated = cut_lineage(found.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias(doc)))
    dropped = found.filter("not kept and doc_id is not null").select(F.col("doc_id").alias(doc))
    same_id = F.col("doc_id").cast("long") == F.col(doc)
    if repeated.isEmpty():
        return docs.join(bounded(dropped), same_id, "left_anti")
    # rows without a doc_id of their own: of those with a text that stays, one each
    some = bounded(repeated.filter(F.col(doc).isNotNull()))
    single = docs.filter("doc_id is not null").join(some, same_id, "left_anti").join(bounded(dropped.join(repeated, doc, "left_anti")), same_id, "left_anti")
    other = docs.filter("doc_id is null").unionByName(docs.join(some, same_id, "left_semi"))
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    stay = found.filter("kept").select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha))
    stay = stay.join(repeated.withColumnRenamed(doc, "again"), F.col(doc).eqNullSafe(F.col("again")), "left_semi")
    plain = [c for f, c in zip(docs.schema.fields, own(docs), strict=True) if "map<" not in f.dataType.simpleString()]
    other = other.select(
        F.col("doc_id").cast("long").alias(doc), F.sha2(F.encode(text, "UTF-8"), 256).alias(sha), F.xxhash64(*plain).alias(order), F.struct(*own(docs)).alias(whole)
    )
    first = other.groupBy(doc, sha).agg(F.min_by(whole, order).alias(whole)).alias("a")
    kept = first.join(stay.alias("b"), F.col(f"a.{doc}").eqNullSafe(F.col(f"b.{doc}")) & (F.col(f"a.{sha}") == F.col(f"b.{sha}")), "left_semi")
    return single.unionByName(kept.select(f"{whole}.*"))
