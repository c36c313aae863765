"""Inverted index as Parquet tables: postings, document statistics, lexicon."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.operators import counting, varbyte

POSTING = ("term", "doc_id", "tf", "data_length", "word_count")


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, tf, data_length, word_count), doc_stats(doc_id, data_length, word_count), lexicon(term, df, max_tf).

    Postings are dealt out by doc_id, as the shards of a search engine are, so what a query adds up for a document and
    its best hits are found where they lie. A saved index also has `totals`: one row of n_docs, avg_words, avg_bytes.
    """

    postings: DataFrame
    doc_stats: DataFrame
    lexicon: DataFrame
    totals: DataFrame | None = None

    def corpus(self) -> DataFrame:
        """One row: n_docs, avg_words, avg_bytes."""
        if self.totals is not None:
            return self.totals.drop("n_shards")
        return self.doc_stats.agg(
            F.count("*").alias("n_docs"), F.avg("word_count").alias("avg_words"), F.avg("data_length").alias("avg_bytes")
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        totals = spark.read.parquet(f"{path}/totals")
        spark.read.parquet(f"{path}/postings").limit(0).createOrReplaceTempView("heronlake_schema")
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.table("heronlake_schema").schema.fields)
        spark.catalog.dropTempView("heronlake_schema")
        n, name = totals.first().n_shards, _table(path)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY (doc_id) SORTED BY (term, doc_id) INTO {n} BUCKETS LOCATION '{path}/postings'")
        return Index(spark.table(name), *(spark.read.parquet(f"{path}/{t}") for t in ("doc_stats", "lexicon")), totals)


def _table(path: str) -> str:
    """The name of the session's table over a saved index's postings."""
    return "postings_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def create(docs: DataFrame, path: str, shards: int | None = None) -> Index:
    """Build a saved index; each text is moved to its shard and its tokens are counted there.

    Within a shard postings are sorted by term, so a query's terms prune row groups.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _table(path)
    _postings(docs, n).select(*POSTING).write.format("parquet").bucketBy(n, "doc_id").sortBy("term", "doc_id").option("path", f"{path}/postings").saveAsTable(name)
    written = spark.table(name)
    lexicon(written).sort("term").write.parquet(f"{path}/lexicon")
    document_stats(docs).write.parquet(f"{path}/doc_stats")
    totals = Index(written, spark.read.parquet(f"{path}/doc_stats"), written).corpus()
    totals.withColumn("n_shards", F.lit(n)).coalesce(1).write.parquet(f"{path}/totals")
    return Index.load(spark, path)


def subset(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is listed."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def _length() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _length().alias("data_length"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def _counted(rows: DataFrame, count: Callable, *columns: str) -> DataFrame:
    """rows of `_texts` through a function of `counting`, which adds `columns`."""
    kinds = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.StringType() if c == "term" else T.IntegerType()) for c in ("data_length", *columns)]])
    return rows.mapInArrow(count, kinds)


def _postings(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(doc_id, data_length, word_count, term, tf). Texts are dealt out by doc_id; tokens are counted where their text is, without a further shuffle."""
    rows = _texts(docs)
    rows = rows.repartition(shards, "doc_id") if shards else rows.repartition("doc_id")
    return _counted(rows.sortWithinPartitions("doc_id"), counting.postings, "word_count", "term", "tf")


def term_frequencies(docs: DataFrame) -> DataFrame:
    return _postings(docs).select("term", "doc_id", "tf")


def document_stats(docs: DataFrame) -> DataFrame:
    return _counted(_texts(docs), counting.lengths, "word_count")


def lexicon(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").cast("int").alias("df"), F.max("tf").alias("max_tf"))


def build(docs: DataFrame) -> Index:
    """An index that is computed when it is read; `create` writes one that is searched again and again."""
    postings = _postings(docs).select(*POSTING)
    return Index(postings, document_stats(docs), lexicon(postings))


def merge_partials(*parts: DataFrame) -> DataFrame:
    """Postings of several partial indexes as one: frequencies of one document add up."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))


def inverted_lists(postings: DataFrame) -> DataFrame:
    """Nested form: each term with its array of (doc_id, tf) by doc_id."""
    return postings.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def merged_lines(postings: DataFrame) -> DataFrame:
    """Text form `term:doc tf,doc tf`."""
    pairs = F.transform("postings", lambda p: F.concat_ws(" ", p["doc_id"].cast("string"), p["tf"].cast("string")))
    return inverted_lists(postings).select("term", F.concat(F.col("term"), F.lit(":"), F.array_join(pairs, ",")).alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Postings of the text form; column `line`."""
    at = F.length("line") - F.locate(":", F.reverse("line")) + 1
    # the term is cut off below the explode: above it, each posting would read its whole line again
    lists = lines.select(F.substr("line", F.lit(1), at - 1).alias("term"), F.substr("line", at + 1).alias("list"))
    rows = lists.select("term", F.explode(F.split("list", ",")).alias("p"))
    two = F.split("p", " ")
    return rows.select("term", two[0].cast("long").alias("doc_id"), two[1].cast("int").alias("tf"))


CHUNK = 64


#: doc_ids of one range, within which postings of a term are numbered by one task.
RANGE = 1 << 20


def chunked(postings: DataFrame) -> DataFrame:
    """Postings with their chunk of 64 and the gap to the chunk's previous doc_id (the id itself at its start).

    Numbers come from counts per range of doc_ids and places within one, so a frequent term's list is dealt out.
    """
    rows = postings.select("term", "doc_id", "tf", F.floor(F.col("doc_id") / RANGE).alias("range"))
    counts = rows.groupBy("term", "range").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    ahead = F.expr("coalesce(sum(n) over (partition by term order by range rows between unbounded preceding and 1 preceding), 0)")
    counts = counts.select("term", "range", ahead.alias("ahead"), F.expr("lag(last) over (partition by term order by range)").alias("last"))
    within = "over (partition by term, range order by doc_id)"  # one sort serves both
    rows = rows.withColumn("nth", F.expr(f"row_number() {within}")).withColumn("previous", F.expr(f"lag(doc_id) {within}")).join(counts, ["term", "range"])
    place = F.col("ahead") + F.col("nth") - 1
    gap = F.col("doc_id") - F.when(place % CHUNK == 0, 0).otherwise(F.coalesce("previous", "last"))
    return rows.select("term", "doc_id", "tf", (place / CHUNK).cast("int").alias("chunk"), gap.alias("delta"))


def restored(chunks: DataFrame) -> DataFrame:
    """doc_ids from gaps."""
    return chunks.withColumn("restored_id", F.expr("sum(delta) over (partition by term, chunk order by doc_id rows unbounded preceding)"))


def varbyte_length(value):
    """Bytes of a number in 7-bit groups; zero takes one."""
    out = F.lit(1)
    for k in range(1, 9):
        out = F.when(value >= 1 << (7 * k), k + 1).otherwise(out)
    return out


def varbyte_encode(values: Column) -> Column:
    """Bytes (as integers) of an array of numbers from 0: groups of 7 bits, low ones first, marked by the high bit where more follow."""
    return F.arrow_udf(varbyte.encode, "array<int>")(values.cast("array<long>"))


def varbyte_decode(coded: Column) -> Column:
    """The array of numbers (long) that `varbyte_encode` made into bytes."""
    return F.arrow_udf(varbyte.decode, "array<long>")(coded)


def chunk_metadata(postings: DataFrame) -> DataFrame:
    return chunked(postings).groupBy("term", "chunk").agg(
        F.max("doc_id").alias("last_doc_id"), F.count("*").alias("n_postings"),
        F.sum(varbyte_length(F.col("delta"))).alias("id_bytes"), F.sum(varbyte_length(F.col("tf"))).alias("tf_bytes"),
    )


def blocks(metadata: DataFrame, capacity: int = 65536) -> DataFrame:
    """Number of blocks per term when chunks (12 bytes of head each) fill blocks greedily."""
    sizes = metadata.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("chunk", (F.col("id_bytes") + F.col("tf_bytes") + 12).alias("size")))).alias("c"))
    zero = F.struct(F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("used"))

    def step(acc, c):
        full = (acc["used"] > 0) & (acc["used"] + c["size"] > capacity)
        return F.struct(F.when(full, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(full, c["size"]).otherwise(acc["used"] + c["size"]).alias("used"))

    return sizes.select("term", F.aggregate("c", zero, step)["n"].alias("n_blocks"))


def order_violations(postings: DataFrame) -> DataFrame:
    """Chunks' postings that do not ascend; none in a sound index."""
    return chunked(postings).filter("delta < 0")


def next_at_least(lists: DataFrame, bound: int) -> DataFrame:
    """For each nested list the first doc_id >= bound (null past its end)."""
    ids = F.filter(F.transform("postings", lambda p: p["doc_id"]), lambda d: d >= bound)
    return lists.select("term", F.array_min(ids).alias("next_doc_id"))


def combine(postings: DataFrame, left: str, right: str, how: str) -> DataFrame:
    """doc_ids of two terms' lists: union, intersect or except."""
    a, b = (postings.filter(F.col("term") == t).select("doc_id") for t in (left, right))
    if how not in ("union", "intersect", "except"):
        raise ValueError(f"unknown set operation {how!r}")
    return a.union(b).distinct() if how == "union" else a.intersect(b) if how == "intersect" else a.subtract(b)


def positions(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Byte offset of each row in a `doc_id \\t text` file written in `order`.

    Sums per range partition are added up first, so no task holds all rows.
    """
    line = F.octet_length(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.coalesce("text", F.lit("")))) + 1
    rows = docs.select("doc_id", F.col(order).alias("o"), line.cast("long").alias("bytes")).repartitionByRange("o").withColumn("part", F.spark_partition_id())
    from heronlake.session import cut_lineage

    rows = cut_lineage(rows)
    before = rows.groupBy("part").agg(F.sum("bytes").alias("b"))
    before = before.select("part", F.expr("coalesce(sum(b) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("ahead"))
    own = F.expr("sum(bytes) over (partition by part order by o, doc_id rows unbounded preceding) - bytes")
    return rows.withColumn("own", own).join(F.broadcast(before), "part").select("doc_id", (F.col("ahead") + F.col("own")).alias("doc_pos"))
