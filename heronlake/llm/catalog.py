"""Queries of the training-data operators over their whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import chat_format, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, secret_scan, token_counts, vector_tree


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages, judged together; a page's doc_id is -1 - page_id.

    A document's host is its source. Of a page, host and suffix come from the address and the declared language from the markup.
    """
    docs, pages = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").alias("host"), none.alias("suffix"), none.alias("declared"))
    evidence = {k: v.alias(k) for k, v in language_id.page_evidence(pages).items()}
    rows = rows.unionByName(pages.select((-1 - F.col("page_id")).alias("doc_id"), language_id.page_texts(pages).alias("text"), *evidence.values()))
    found = language_id.identify(rows, language_id.fit_text_model(docs), host=F.col("host"), suffix=F.col("suffix"), declared=F.col("declared"))
    page = F.when(F.col("doc_id") < 0, -1 - F.col("doc_id")).alias("page_id")
    return found.select("doc_id", page, F.col("lang").alias("detected_lang"), "posterior", "accepted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op3_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_counts(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_packing_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: every assistant turn of `conversations` with the turn before it, which bears no loss, under all three limits."""
    turns = _read(spark, sf_dir, "conversations")
    answers = turns.filter("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    asks = turns.filter("role <> 'assistant'").select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t"), F.col("text").alias("ask"))
    pairs = answers.join(asks, (F.col("doc_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return packing.pack(pairs, max_segments=64, max_loss=1536, ask_col="ask")


def op5_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.search(_read(spark, sf_dir, "embeddings"), k=20, query_step=20)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_read(spark, sf_dir, "documents")).drop("n_chunks")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(talks.unionByName(extra))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.strip_boilerplate(_read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_language_id, op2_token_counts, op3_ngram_join, op4_packing, op5_vector_tree, op6_exact_dedup, op7_chat_format, op8_secret_scan, op9_line_dedup, op10_mixing, op3_ngram_links, op4_packing_instructions)
    return {f.__name__: f for f in found}


_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w
), t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM s
JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""

#: The same with the number of a document's links.
_OP3_LINKS = _OP3.replace("c.component_id FROM s", "c.component_id, coalesce(d.n_links, 0) AS n_links FROM s") + """
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a) d USING (doc_id)"""

_OP6 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t"""

#: Of op7_chat_format, all but formatted_chars: tests compare those columns.
OP7_DIGESTS = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id"""

_OP9 = r"""
WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
x AS (SELECT DISTINCT doc_id, source, trim(u) AS line FROM (SELECT doc_id, source, unnest(ls) AS u FROM l) WHERE trim(u) <> ''),
b AS (SELECT x.source, list(line) AS bad FROM (SELECT source, line, count(*) AS n FROM x GROUP BY source, line) x
  JOIN t ON x.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n > 0.05 * pages GROUP BY x.source),
k AS (SELECT doc_id, ls, list_filter(ls, lambda y: NOT list_contains(coalesce(bad, []), trim(y))) AS ks
  FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(ks), 0) AS BIGINT) AS n_dropped,
  sha256(array_to_string(ks, chr(10))) AS text_sha256 FROM k"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": _OP3, "op3_ngram_links": _OP3_LINKS, "op6_exact_dedup": _OP6, "op9_line_dedup": _OP9}
