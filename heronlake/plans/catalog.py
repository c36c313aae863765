"""Queries over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake import console
from heronlake.functions import arrays, times
from heronlake.functions import text as T
from heronlake.functions import url as U
from heronlake.functions import vectors as V
from heronlake.operators import bm25, crawl, dense, evaluate, index, rerank, training
from heronlake.plans import oracles as O
from heronlake.session import shared_folder
from heronlake.sources import collections, trec
from heronlake.streaming import crawl_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOP, STEP = 20, 100  # results per query; the vectors whose ids are divisible by 100 ask


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark, d):
    return read(spark, d, "documents").select("doc_id", "text")


def asked(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def vector_queries(spark, d):
    rows = vectors(spark, d).filter(F.col("doc_id") % STEP == 0)
    return rows.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


#: Folders of the indexes that this process has saved, by application and tables.
_SAVED: dict[tuple[str, str, str], str] = {}


def _saved(spark, d, name: str, make: Callable[[str], object]) -> str:
    """The folder of an index over the tables in `d`: written by the first query that searches it, read by all."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _SAVED:
        path = shared_folder(spark, name)
        make(path)
        _SAVED[key] = path
    return _SAVED[key]


def saved_index(spark, d) -> index.Index:
    return index.Index.load(spark, _saved(spark, d, "index", lambda path: index.create(documents(spark, d), path)))


def saved_vectors(spark, d) -> dense.HashedIndex:
    corpus = vectors(spark, d).select("doc_id", "embedding")
    return dense.HashedIndex.load(spark, _saved(spark, d, "vectors", lambda path: dense.HashedIndex.build(corpus).save(path)))


def shown(run: DataFrame) -> DataFrame:
    """Scores with 6 decimals."""
    return run.withColumn("score", F.round("score", 6))


def vector_run(spark, d):
    return dense.exact_top_k(vector_queries(spark, d), vectors(spark, d).select("doc_id", "embedding"), 50)


def vector_qrels(spark, d):
    """Vectors of the query's label are relevant; grade 2 for even ids."""
    q = vector_queries(spark, d).select("query_id", "label")
    q = F.broadcast(q) if q.count() <= dense.BROADCAST_QUERIES else q  # there are few labels: dealt out by them, all rows would lie in few tasks
    return vectors(spark, d).join(q, "label").select("query_id", "doc_id", (2 - F.col("doc_id") % 2).cast("int").alias("rel"))


def pages(spark, d):
    return read(spark, d, "pages")


def visits(spark, d):
    """Events as crawl visits."""
    e = read(spark, d, "events")
    return e.select("event_id", "user_id", "ts", F.floor(F.abs("value") * 1000).cast("long").alias("size"), F.when(F.col("event_type") == "click", "200").otherwise(F.col("event_type")).alias("status"))


@query(O.TF)
def term_freq(spark, d):
    return index.term_frequencies(documents(spark, d))


@query(O.STATS + "SELECT doc_id, data_length, word_count FROM stats")
def doc_stats(spark, d):
    return index.document_stats(documents(spark, d))


@query(O.STATS + "SELECT count(*) AS n_docs, round(avg(word_count), 6) AS avg_words, round(avg(data_length), 6) AS avg_bytes, CAST(floor(avg(word_count)) AS BIGINT) AS floor_words FROM stats")
def corpus_stats(spark, d):
    s = index.document_stats(documents(spark, d))
    return s.agg(F.count("*").alias("n_docs"), F.round(F.avg("word_count"), 6).alias("avg_words"), F.round(F.avg("data_length"), 6).alias("avg_bytes"), F.floor(F.avg("word_count")).alias("floor_words"))


@query(O.POSTINGS + "SELECT term, CAST(count(*) AS INTEGER) AS df, CAST(max(tf) AS INTEGER) AS max_tf FROM postings GROUP BY term")
def lexicon_df(spark, d):
    return index.lexicon(index.term_frequencies(documents(spark, d)))


@query(O.POSTINGS + "SELECT term, term || ':' || string_agg(doc_id || ' ' || tf, ',' ORDER BY doc_id) AS line FROM postings GROUP BY term")
def inverted_list(spark, d):
    return index.merged_lines(index.term_frequencies(documents(spark, d)))


@query(O.TF)
def inverted_list_import(spark, d):
    return index.parse_lines(index.merged_lines(index.term_frequencies(documents(spark, d))))


@query(O.TF)
def merge_partials(spark, d):
    """Partial indexes that share documents: of each text's first line, and of the rest."""
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    rest = F.substr(F.col("text"), F.length(first) + 2)
    return index.merge_partials(*[index.term_frequencies(documents(spark, d).withColumn("text", part)) for part in (first, rest)])


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def subset_scan(spark, d):
    return index.subset(documents(spark, d), read(spark, d, "labels"))


@query(O.POSTINGS + ", s AS (SELECT doc_id FROM documents) SELECT (SELECT count(*) FROM postings) AS n_postings, (SELECT count(DISTINCT term) FROM postings) AS n_terms, (SELECT count(*) FROM s) AS n_docs")
def index_build(spark, d):
    """A whole index, written and counted."""
    built = index.create(documents(spark, d), shared_folder(spark, "index"))
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    return one(built.postings, "n_postings").crossJoin(one(built.lexicon, "n_terms")).crossJoin(one(built.doc_stats, "n_docs"))


@query(O.TF)
def saved_postings(spark, d):
    return saved_index(spark, d).postings.select("term", "doc_id", "tf")


@query(O.POSTINGS + "SELECT term, doc_id, tf FROM postings WHERE term IN ('the', 'la', 'und')")
def saved_postings_of_terms(spark, d):
    """The filter reaches the scan of the saved postings."""
    return saved_index(spark, d).postings.filter(F.col("term").isin("the", "la", "und")).select("term", "doc_id", "tf")


@query(O.STATS + "SELECT doc_id, data_length, word_count FROM stats")
def saved_doc_stats(spark, d):
    return saved_index(spark, d).doc_stats


@query(O.POSTINGS + "SELECT term, CAST(count(*) AS INTEGER) AS df, CAST(max(tf) AS INTEGER) AS max_tf FROM postings GROUP BY term")
def saved_lexicon(spark, d):
    return saved_index(spark, d).lexicon


def _search(spark, d, **options):
    return shown(bm25.search(asked(spark, d), saved_index(spark, d), k=TOP, **options)).select("query_id", "doc_id", "rank", "score")


@query(O.bm25())
def bm25_or_topk(spark, d):
    return _search(spark, d, mode="or")


@query(O.bm25(mode="and"))
def bm25_and_topk(spark, d):
    return _search(spark, d, mode="and")


@query(O.bm25(length="data_length"))
def bm25_bytes_or(spark, d):
    return _search(spark, d, length="bytes")


@query(O.bm25(average="floor(avg(word_count))"))
def bm25_floor_avg(spark, d):
    return _search(spark, d, floor_average=True)


@query(O.bm25(asked=O.cased_tokens("text")))
def bm25_case_sensitive_query(spark, d):
    return _search(spark, d, canonical=False)


@query(O.bm25(content=True))
def bm25_with_content(spark, d):
    found = bm25.search(asked(spark, d), saved_index(spark, d), k=TOP, docs=documents(spark, d))
    return found.select("query_id", "doc_id", "rank", T.result_line(F.col("doc_id"), F.lit(0.0), F.col("content")).alias("line"))


@query(O.max_impact())
def max_term_impact(spark, d):
    i = saved_index(spark, d)
    hits = i.postings.join(i.lexicon.select("term", "df"), "term").crossJoin(F.broadcast(i.corpus()))
    part = bm25.term_score(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("word_count"), F.col("avg_words"))
    return hits.groupBy("term").agg(F.round(F.max(part), 6).alias("max_impact"))


@query("SELECT doc_id, CAST(coalesce(sum(octet_length(encode(doc_id || chr(9) || coalesce(text, ''))) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS doc_pos FROM documents")
def doc_positions(spark, d):
    return index.positions(documents(spark, d))


@query(O.CHUNKS + "SELECT term, doc_id, chunk, delta FROM chunks")
def posting_deltas(spark, d):
    return index.chunked(index.term_frequencies(documents(spark, d))).select("term", "doc_id", "chunk", "delta")


@query(O.CHUNKS + "SELECT term, doc_id, CAST(sum(delta) OVER (PARTITION BY term, chunk ORDER BY doc_id) AS BIGINT) AS restored_id FROM chunks")
def posting_prefix_sum(spark, d):
    return index.restored(index.chunked(index.term_frequencies(documents(spark, d)))).select("term", "doc_id", "restored_id")


@query(O.METADATA + "SELECT term, chunk, last_doc_id, n_postings, id_bytes, tf_bytes FROM metadata")
def chunk_metadata(spark, d):
    return index.chunk_metadata(index.term_frequencies(documents(spark, d)))


@query(O.blocks(4096))
def chunk_blocks(spark, d):
    return index.blocks(index.chunk_metadata(index.term_frequencies(documents(spark, d))), 4096)


@query("SELECT 'x' AS term, CAST(0 AS BIGINT) AS doc_id WHERE false")
def posting_order_check(spark, d):
    return index.order_violations(index.term_frequencies(documents(spark, d))).select("term", "doc_id")


@query(O.POSTINGS + "SELECT term, min(doc_id) FILTER (doc_id >= 100) AS next_doc_id FROM postings GROUP BY term")
def next_geq(spark, d):
    return index.next_at_least(index.inverted_lists(index.term_frequencies(documents(spark, d))), 100)


def _combine(how):
    return lambda spark, d: index.combine(index.term_frequencies(documents(spark, d)), "the", "la", how)


for _how, _sql in (("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    QUERIES[f"posting_{_how}"] = _combine(_how)
    ORACLES[f"posting_{_how}"] = O.POSTINGS + f"SELECT doc_id FROM postings WHERE term = 'the' {_sql} SELECT doc_id FROM postings WHERE term = 'la'"


@query(O.VECTOR_RUN + "SELECT query_id, 'Q0' AS q0, doc_id, rank, round(score, 6) AS score, 'run2' AS run_name FROM run")
def trec_run(spark, d):
    return trec.run_rows(shown(vector_run(spark, d)), "run2")


@query(O.vector_topk("round(list_inner_product(q.v, c.v), 9)"))
def vector_dot_topk(spark, d):
    return shown(dense.exact_top_k(vector_queries(spark, d), vectors(spark, d), TOP))


@query(O.vector_topk("-" + O.L2, "round({}, 9)"))
def vector_l2_topk(spark, d):
    return shown(dense.exact_top_k(vector_queries(spark, d), vectors(spark, d), TOP, "l2"))


@query(O.vector_topk(f"CASE WHEN {O.L2} = 0 THEN 1e9 ELSE 1 / {O.L2} END", "round({}, 9)"))
def inverse_distance_score(spark, d):
    return shown(dense.exact_top_k(vector_queries(spark, d), vectors(spark, d), TOP, "inverse"))


def _parts(rows: DataFrame, key: str, value) -> DataFrame:
    """A vector's components as rows (key, dim, value), to 6 decimals."""
    return rows.select(key, F.posexplode(value).alias("dim", "x")).select(key, "dim", F.round("x", 6).alias("value"))


@query("SELECT vec_id AS doc_id, CAST(i - 1 AS INTEGER) AS dim, round(v[i] / sqrt(list_inner_product(v, v)), 6) AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), unnest(range(1, 65)) t(i)")
def l2_normalise(spark, d):
    return _parts(vectors(spark, d), "doc_id", V.l2_normalise(F.col("embedding")))


_HASHED = O.hashed(64, dense.TABLES, dense.BITS, dense.PROBES, TOP)


@query(_HASHED + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM run")
def ann_lsh_topk(spark, d):
    return shown(saved_vectors(spark, d).search(vector_queries(spark, d).select("query_id", "vector"), TOP))


@query(_HASHED + ", x AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_inner_product(q.v, c.v), 9) AS score FROM v q, v c WHERE q.vec_id % 100 = 0)) SELECT round(count(run.doc_id) / count(*), 6) AS recall FROM x LEFT JOIN run USING (query_id, doc_id) WHERE r <= 20")
def ann_recall(spark, d):
    """The share of the 20 exact neighbours that the hashed index finds."""
    asks = vector_queries(spark, d).select("query_id", "vector")
    return dense.recall(saved_vectors(spark, d).search(asks, TOP), dense.exact_top_k(asks, vectors(spark, d), TOP))


@query(O.RERANK)
def bm25_then_dense_rerank(spark, d):
    """Documents and queries take the vectors of their own number, where there is one."""
    run = bm25.search(asked(spark, d), saved_index(spark, d), k=100)
    asked_vectors = vectors(spark, d).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    return shown(rerank.rerank_dense(run, asked_vectors, vectors(spark, d), 100, TOP))


@query(O.OVERLAP)
def cross_encoder_rerank(spark, d):
    run = bm25.search(asked(spark, d), saved_index(spark, d), k=50)
    return shown(rerank.rerank_pairs(run, asked(spark, d), documents(spark, d), first=50, last=TOP))


@query(O.ENCODED)
def encode_documents(spark, d):
    """The components of the model-free encoder's vectors that are not 0."""
    rows = rerank.encode(documents(spark, d)).select("doc_id", "embedding")
    return _parts(rows, "doc_id", F.col("embedding")).filter("value <> 0")


def _metric(name, sql):
    def f(spark, d):
        return evaluate.per_query(vector_run(spark, d), vector_qrels(spark, d)).select("query_id", name)

    QUERIES[sql[0]], ORACLES[sql[0]] = f, O.METRICS + f"SELECT query_id, {name} FROM metrics"


for _name, _query in (("p_10", "precision_at_k"), ("recall_30", "recall_at_k"), ("map", "average_precision"), ("ndcg_10", "ndcg_at_k"), ("recip_rank", "reciprocal_rank")):
    _metric(_name, (_query,))


@query(O.METRICS + "SELECT round(avg(p_10), 6) AS p_10, round(avg(recall_30), 6) AS recall_30, round(avg(map), 6) AS map, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recip_rank), 6) AS recip_rank FROM metrics")
def mean_metrics(spark, d):
    return evaluate.means(evaluate.per_query(vector_run(spark, d), vector_qrels(spark, d))).select("p_10", "recall_30", "map", "ndcg_10", "recip_rank")


@query(O.MRR)
def mrr_all_queries(spark, d):
    return evaluate.mrr(vector_run(spark, d), vector_qrels(spark, d).filter("rel = 1"))


@query("SELECT item_id AS query_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels)")
def judged_query_filter(spark, d):
    return training.judged_queries(asked(spark, d), read(spark, d, "labels").select(F.col("doc_id").alias("query_id"))).select("query_id")


@query(O.QRELS + "SELECT query_id, doc_id, 1 AS label FROM qrels WHERE rel = 1")
def train_positives(spark, d):
    q = vector_queries(spark, d)
    return training.positives(vector_qrels(spark, d), q, vectors(spark, d))


@query(O.QRELS + "SELECT q.vec_id AS query_id, c.vec_id AS doc_id FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND (q.vec_id, c.vec_id) NOT IN (SELECT query_id, doc_id FROM qrels)")
def train_negative_candidates(spark, d):
    return training.negative_candidates(vector_qrels(spark, d), vector_queries(spark, d), vectors(spark, d))


@query(O.VECTOR_NEGATIVES + "SELECT query_id, doc_id, label FROM negatives")
def sampled_negatives(spark, d):
    return training.negatives(vector_qrels(spark, d), vector_queries(spark, d), vectors(spark, d))


@query(O.VECTOR_NEGATIVES + "SELECT label, count(*) AS n FROM (SELECT * FROM positives UNION ALL SELECT * FROM negatives) GROUP BY label")
def label_counts(spark, d):
    sides = vector_qrels(spark, d), vector_queries(spark, d), vectors(spark, d)
    return training.label_counts(training.positives(*sides).unionByName(training.negatives(*sides)))


@query(O.LINKS + "SELECT page_id, position, href FROM links")
def extract_links(spark, d):
    return crawl.links(pages(spark, d)).select("page_id", "position", "href")


@query(O.LINKS + "SELECT page_id, position, dst_url FROM links")
def resolve_links(spark, d):
    return crawl.links(pages(spark, d)).select("page_id", "position", "dst_url")


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '', 's') AS normalized FROM pages")
def normalize_url(spark, d):
    return pages(spark, d).select("page_id", U.normalize(F.col("url")).alias("normalized"))


@query(f"SELECT page_id, {O.minimized('url')} AS minimized FROM pages")
def minimize_url(spark, d):
    return pages(spark, d).select("page_id", U.minimize(F.col("url")).alias("minimized"))


@query(f"SELECT page_id, {O.domain('url')} AS domain, {O.second_last(O.domain('url'))} AS label FROM pages")
def domain_parts(spark, d):
    host = U.domain(F.col("url"))
    return pages(spark, d).select("page_id", host.alias("domain"), U.second_last(host).alias("label"))


@query(f"SELECT page_id, url FROM pages WHERE {O.valid('url', '.org')}")
def valid_url_filter(spark, d):
    return pages(spark, d).filter(U.is_valid(F.col("url"), ".org")).select("page_id", "url")


@query(O.EDGES + "SELECT page_id, src_domain, dst_domain, min_url FROM edges")
def link_graph(spark, d):
    return crawl.edges(pages(spark, d)).select("page_id", "src_domain", "dst_domain", "min_url")


@query(O.DOMAINS + "SELECT domain, enqueue_count, in_degree FROM domains")
def domain_counters(spark, d):
    return crawl.domain_counters(crawl.edges(pages(spark, d)))


@query(f"SELECT {O.second_last(O.domain('url'))} AS label, count(*) AS visits FROM pages GROUP BY 1 HAVING label IS NOT NULL")
def second_last_counts(spark, d):
    return crawl.second_last_counts(pages(spark, d))


def _prioritised(spark, d):
    e = crawl.edges(pages(spark, d))
    return crawl.prioritise(crawl.unseen(e, pages(spark, d).select(U.minimize(F.col("url")).alias("min_url"))), crawl.domain_counters(e), crawl.second_last_counts(pages(spark, d)))


@query(O.PRIORITIES + "SELECT min_url, final_priority FROM priorities")
def crawl_priority(spark, d):
    return _prioritised(spark, d).select("min_url", "final_priority")


@query(O.PRIORITIES + "SELECT min_url, final_priority FROM priorities ORDER BY final_priority, min_url LIMIT 50")
def frontier_topk(spark, d):
    return crawl.frontier_head(_prioritised(spark, d).withColumn("queue_index", F.col("min_url")), 50).select("min_url", "final_priority")


@query(O.UNSEEN + "SELECT min_url, url FROM unseen")
def unseen_links(spark, d):
    return crawl.unseen(crawl.edges(pages(spark, d)), pages(spark, d).select(U.minimize(F.col("url")).alias("min_url")))


@query(O.PAGE_COUNTERS)
def page_link_counters(spark, d):
    return crawl.page_counters(crawl.edges(pages(spark, d)), pages(spark, d).select(U.minimize(F.col("url")).alias("min_url")), ".org")


@query(O.VISITS + "SELECT count(*) AS total_pages, count(*) FILTER (status = '200') AS successful_pages, CAST(sum(size) AS BIGINT) AS total_bytes, round(sum(size) / 1048576, 6) AS total_mb, round(sum(size) / count(*) FILTER (status = '200') / 1024, 6) AS average_kb FROM visits")
def crawl_totals(spark, d):
    return crawl.totals(visits(spark, d))


@query(O.VISITS + "SELECT status, count(*) AS n FROM visits GROUP BY status")
def status_histogram(spark, d):
    return crawl.status_histogram(visits(spark, d))


@query("SELECT event_id, round(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts), 6) AS gap FROM events")
def politeness_gaps(spark, d):
    return crawl.politeness_gaps(read(spark, d, "events"), "user_id", "ts").select("event_id", "gap")


@query(O.breadth_first(3, 200, 20))
def bfs_rounds(spark, d):
    seeds = crawl.sample_seeds(pages(spark, d).select("url"), 20)
    return crawl.breadth_first(crawl.edges(pages(spark, d)), seeds)


@query("SELECT doc_id, 'DocId: ' || doc_id || ', Score: ' || printf('%.6f', n_chars / 8.0) || ', Content: ' || replace(text, ',', ' ') AS line FROM documents")
def result_line_format(spark, d):
    rows = read(spark, d, "documents")
    return rows.select("doc_id", T.result_line(F.col("doc_id"), F.col("n_chars") / F.lit(8.0), F.col("text")).alias("line"))


@query("SELECT doc_id, CAST(n_chars / 8.0 AS DOUBLE) AS score, replace(text, ',', ' ') AS content FROM documents")
def result_line_parse(spark, d):
    lines = result_line_format(spark, d).select(T.parse_result_line(F.col("line")).alias("p"))
    return lines.select("p.doc_id", "p.score", "p.content")


@query("SELECT source AS dataset, " + ", ".join(f"round(avg(n_chars) FILTER (lang = '{x}'), 6) AS {x}" for x in ("en", "fr", "de", "es")) + " FROM documents GROUP BY source")
def metric_pivot(spark, d):
    """Mean length by source and language, as experiments by data set and encoder."""
    return evaluate.metric_pivot(_experiments(spark, d), "value", ["en", "fr", "de", "es"])


def _experiments(spark, d):
    rows = read(spark, d, "documents").groupBy(F.col("source").alias("dataset"), F.col("lang").alias("encoder"))
    return rows.agg(F.round(F.avg("n_chars"), 6).alias("value"))


@query("SELECT coalesce(round(avg(n_chars) FILTER (source = 'src0' AND lang = 'fr'), 6), 'NaN'::DOUBLE) AS value FROM documents")
def metric_pick(spark, d):
    return evaluate.pick(_experiments(spark, d), "value", dataset="src0", encoder="fr")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return crawl_stream.windowed_counts(read(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _lines(spark, d):
    """Lines of a collection file: all documents, and the benchmark's texts, which have no id."""
    documents_ = documents(spark, d).select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("value"))
    return documents_.unionByName(asked(spark, d).select(F.col("text").alias("value")))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def passage_scan(spark, d):
    return collections.parse_passages(_lines(spark, d))[0]


@query("SELECT text AS value FROM benchmark")
def passage_rejects(spark, d):
    return collections.parse_passages(_lines(spark, d))[1]


@query(O.VECTOR_RUN + "SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 6) AS score, rank FROM run WHERE rank <= 30")
def trec_run_file(spark, d):
    """A run written as a file and read back, its first 30 lines per query."""
    path = shared_folder(spark, "run")
    trec.write_run(vector_run(spark, d), path, "run2")
    return shown(trec.read_run(spark, path, first=30))


@query(f"SELECT doc_id, array_to_string({O.tokens('text')}, ' ') AS tokens FROM documents")
def index_tokenize(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(T.index_tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT item_id AS query_id, array_to_string({O.tokens('text')}, ' ') AS tokens FROM benchmark")
def query_tokenize(spark, d):
    return asked(spark, d).select("query_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '') AS title, split_part(html, chr(10), 1) AS first_line, url AS stripped, 'passage: ' || url AS prefixed FROM pages")
def text_helpers(spark, d):
    line = F.concat(F.col("page_id").cast("string"), F.lit("\t"), F.col("url"))
    return pages(spark, d).select(
        "page_id", T.between_tags(F.col("html"), "<title>", "</title>").alias("title"), T.first_line(F.col("html")).alias("first_line"),
        T.strip_id_prefix(line).alias("stripped"), T.with_prefix(F.col("url"), "passage").alias("prefixed"),
    )


@query(O.CHUNKS + f", e AS (SELECT term, doc_id, {O.varbyte('delta')} + {O.varbyte('tf')} AS n_bytes, delta, tf FROM chunks) SELECT term, doc_id, CAST(n_bytes AS INTEGER) AS n_bytes, delta, CAST(tf AS BIGINT) AS tf FROM e")
def varbyte_codec(spark, d):
    """Each posting's gap and count as bytes, and what the bytes decode to."""
    rows = index.chunked(index.term_frequencies(documents(spark, d)))
    coded = rows.select("term", "doc_id", index.varbyte_encode(F.array("delta", "tf")).alias("bytes"))
    back = index.varbyte_decode(F.col("bytes"))
    return coded.select("term", "doc_id", F.size("bytes").alias("n_bytes"), back[0].alias("delta"), back[1].alias("tf"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round((v[i] + label % 2 * v[65 - i]) / (1 + label % 2), 6) AS value FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), unnest(range(1, 65)) t(i)")
def mean_pooling(spark, d):
    tokens, mask = F.array("embedding", F.reverse("embedding")), F.array(F.lit(1), F.col("label") % 2)
    return _parts(read(spark, d, "embeddings"), "vec_id", V.mean_pool(tokens, mask))


@query(O.bm25(k=100).rsplit("SELECT", 1)[0] + "SELECT query_id, doc_id FROM hits WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def rerank_missing(spark, d):
    """Candidates that a dense reranker leaves out, having no vector."""
    run = bm25.search(asked(spark, d), saved_index(spark, d), k=100)
    return rerank.missing_vectors(run, vectors(spark, d)).select("query_id", "doc_id")


@query(O.METRICS + """SELECT query_id, '{"p_10":"' || printf('%.4f', p_10) || '","recip_rank":"' || printf('%.4f', recip_rank) || '"}' AS metrics FROM metrics""")
def metrics_json(spark, d):
    return evaluate.metrics_json(evaluate.per_query(vector_run(spark, d), vector_qrels(spark, d)).select("query_id", "p_10", "recip_rank"))


def _judged_pairs(spark, d):
    """Labelled documents as judgements of the benchmark's queries, dealt out by id."""
    n = F.lit(asked(spark, d).count())
    return read(spark, d, "labels").select((F.col("doc_id") % n).alias("query_id"), "doc_id", F.col("quality").alias("rel"))


@query(O.TEXT_NEGATIVES + "SELECT * FROM positives UNION ALL SELECT * FROM negatives")
def training_examples(spark, d):
    return training.examples(_judged_pairs(spark, d), asked(spark, d), documents(spark, d)).select("query_id", "doc_id", "label")


@query(O.TEXT_NEGATIVES + """SELECT * FROM (SELECT * FROM positives ORDER BY md5('l1:' || query_id || ':' || doc_id), query_id, doc_id LIMIT 100)
UNION ALL SELECT * FROM (SELECT * FROM negatives ORDER BY md5('l1:' || query_id || ':' || doc_id), query_id, doc_id LIMIT 1000)""")
def limited_examples(spark, d):
    rows = training.examples(_judged_pairs(spark, d), asked(spark, d), documents(spark, d)).select("query_id", "doc_id", "label")
    return training.limited(rows, 100, 1000)


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'MIME Type Not HTML' WHEN event_type = 'click' THEN '200' ELSE event_type END AS outcome FROM events")
def page_outcome(spark, d):
    """Clicks are fetched pages and views fetched files; all others failed by name."""
    kind = F.when(F.col("event_type") == "view", "application/json").otherwise("text/html; charset=UTF-8")
    status = F.when(F.col("event_type").isin("view", "click"), "200").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", status.alias("status"), kind.alias("content_type")).select("event_id", crawl.outcome().alias("outcome"))


@query("SELECT page_id AS \"order\", 'Depth: 0, Status: 200, (seed)URL: ' || url || ', Time: 2024-01-01 00:00:00, Size: ' || octet_length(encode(html)) || ' bytes' AS line FROM pages")
def crawl_log(spark, d):
    """The log of a crawl whose seeds are all pages."""
    visits_ = pages(spark, d).select(
        F.col("page_id").alias("order"), "url", F.octet_length("html").alias("size"), F.lit("200").alias("status"), F.lit(0).alias("depth"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("time"), F.lit(None).cast("string").alias("redirect_url"), F.lit(True).alias("is_seed"),
    )
    return crawl.log_lines(visits_)


@query(O.LINKS + f"SELECT DISTINCT {O.minimized('url')} AS min_url FROM (SELECT url FROM pages UNION ALL SELECT dst_url FROM links WHERE position = 0)")
def redirects_seen(spark, d):
    """Each page redirects to its first link; both count as seen."""
    to = crawl.links(pages(spark, d)).filter("position = 0").select(F.col("src_url").alias("url"), F.col("dst_url").alias("final_url"))
    return crawl.follow_redirects(pages(spark, d), to)


@query(f"""SELECT url, NOT ((ends_with(h, '.org') AND starts_with(p, '/en/')) OR (ends_with(h, '.net') AND starts_with(p, '/fr/'))) AS allowed
FROM (SELECT url, {O.domain('url')} AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def robots_filter(spark, d):
    """Hosts in .org forbid /en/, those in .net /fr/; the others have no file."""
    urls = pages(spark, d).select("url")
    files = urls.select(U.robots_url(F.col("url")).alias("robots_url"), U.domain(F.col("url")).alias("host")).distinct()
    rule = F.when(F.endswith("host", F.lit(".org")), "User-agent: *\nDisallow: /en/\n").when(F.endswith("host", F.lit(".net")), "User-agent: *\nDisallow: /fr/\n")
    return crawl.robots_allowed(urls, files.select("robots_url", rule.alias("text")).filter("text is not null"))


@query(f"SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/robots.txt' AS robots_url FROM pages")
def robots_url(spark, d):
    return pages(spark, d).select("page_id", U.robots_url(F.col("url")).alias("robots_url"))


@query(O.SCALES)
def priority_scales(spark, d):
    """The three priority scales at each document's length; labels are the languages."""
    n = F.col("n_chars")
    return read(spark, d, "documents").select(
        "doc_id", U.domain_priority(n).alias("by_domain"), U.in_degree_priority(n).alias("by_in_degree"),
        U.second_last_priority(F.lit("org"), n).alias("by_known"), U.second_last_priority(F.col("lang"), n).alias("by_label"),
    )


def _visit_stream(spark, d):
    """Events as a stream of visits of (url, ts), a host per user."""
    path = f"{d}/events.parquet"
    # the pattern matches that path alone; a plain path would have to be a folder
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    url = F.concat(F.lit("https://www.u"), F.col("user_id").cast("string"), F.lit(".org/"), "event_type", F.lit("?e="), F.col("event_id").cast("string"))
    return rows.select(url.alias("url"), F.col("ts").cast("timestamp").alias("ts"))


@query("SELECT DISTINCT '//u' || user_id || '.org/' || event_type AS min_url FROM events WHERE ts IS NOT NULL")
def stream_first_visits(spark, d):
    """Page identities of a stream, each once."""
    return crawl_stream.drain(crawl_stream.first_visits(_visit_stream(spark, d)).select("min_url"))


@query(O.SCHEDULE)
def stream_schedule(spark, d):
    """A stream of visits, each host's two seconds apart at least."""
    out = crawl_stream.drain(crawl_stream.schedule(_visit_stream(spark, d)))
    return out.select("url", "domain", F.round("wanted_at", 3).alias("wanted_at"), F.round("visit_at", 3).alias("visit_at"))


@query(O.schedule_with_timeouts(30, 20))
def stream_schedule_timeouts(spark, d):
    """Half a minute between a host's visits; what would wait for over 20 seconds is given up."""
    out = crawl_stream.drain(crawl_stream.schedule(_visit_stream(spark, d), least=30.0, give_up=20.0))
    return out.select("url", F.round("wanted_at", 3).alias("wanted_at"), F.round("visit_at", 3).alias("visit_at"), "outcome")


@query(O.LINKS + f""", t AS (SELECT src_url AS url, dst_url AS final_url FROM links WHERE position = 0), seen AS (SELECT {O.minimized('url')} AS m FROM pages WHERE page_id % 2 = 0)
SELECT DISTINCT url, final_url, CASE WHEN final_url IS NULL OR {O.minimized('final_url')} = {O.minimized('url')} THEN 'direct' WHEN NOT ({O.valid('final_url', '.org')}) THEN 'invalid'
  WHEN {O.minimized('final_url')} IN (SELECT m FROM seen) THEN 'seen' ELSE 'followed' END AS outcome FROM pages LEFT JOIN t USING (url)""")
def redirect_outcomes(spark, d):
    """Each page redirects to its first link; the pages with even ids have been seen."""
    to = crawl.links(pages(spark, d)).filter("position = 0").select(F.col("src_url").alias("url"), F.col("dst_url").alias("final_url"))
    seen = pages(spark, d).filter(F.col("page_id") % 2 == 0).select(U.minimize(F.col("url")).alias("min_url"))
    return crawl.redirect_outcomes(pages(spark, d), to, seen, ".org").select("url", "final_url", "outcome").distinct()


_FETCHED = "v AS (SELECT url, octet_length(encode(html)) AS size, CASE WHEN page_id % 3 = 0 THEN url || 'x' END AS redirect_url FROM pages)"


@query(O.UNSEEN.rstrip() + f""", {_FETCHED} SELECT count(*) AS total_pages, count(*) AS successful_pages, CAST(sum(size) AS BIGINT) AS total_bytes, round(sum(size) / 1048576, 6) AS total_mb,
round(sum(size) / count(*) / 1024, 6) AS average_kb, count(redirect_url) AS n_redirects, count(DISTINCT {O.domain('url')}) AS n_domains, (SELECT count(*) FROM unseen) AS queue_size FROM v""")
def crawl_statistics(spark, d):
    """All pages are fetched, every third by a redirect; what they link to and was not fetched waits."""
    fetched = pages(spark, d).select(
        "url", F.octet_length("html").cast("long").alias("size"), F.lit("200").alias("status"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("x"))).alias("redirect_url")
    )
    return crawl.statistics(fetched, unseen_links(spark, d))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d-%H-%M-%S') AS stamp, round(epoch(ts) - epoch(date_trunc('day', ts)), 6) AS seconds FROM events")
def time_helpers(spark, d):
    """A file name's stamp, and the seconds since midnight."""
    rows = read(spark, d, "events")
    return rows.select("event_id", times.file_stamp(F.col("ts")).alias("stamp"), F.round(times.elapsed_seconds(F.date_trunc("day", "ts"), F.col("ts")), 6).alias("seconds"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, unnest(range(1, 6)) t(i)")
def array_prefix(spark, d):
    return _parts(read(spark, d, "embeddings"), "vec_id", arrays.first(F.col("embedding").cast("array<double>"), 5))


@query("SELECT source, max(n) FILTER (lang = 'fr') AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def map_lookup(spark, d):
    """Each source's number of French documents, looked up in its map of languages."""
    counts = read(spark, d, "documents").filter("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    maps = counts.groupBy("source").agg(F.collect_list(F.struct("lang", "n")).alias("p"))  # one entry per language
    return maps.select("source", arrays.lookup(F.col("p.lang"), F.col("p.n"), F.lit("fr")).alias("n"))


@query("""SELECT doc_id, len(string_split(line, ', ')) AS parts, CASE len(string_split(line, ', ')) WHEN 3 THEN 'full' WHEN 2 THEN 'score' ELSE 'other' END AS kind FROM (
SELECT doc_id, 'DocId: ' || doc_id || ', Score: 0.500000' || CASE doc_id % 3 WHEN 0 THEN ', Content: ' || replace(text, ',', ' ') WHEN 1 THEN '' ELSE ', Content: a, b' END AS line FROM documents)""")
def result_line_kinds(spark, d):
    """Lines with content, without, and with too many parts."""
    plain = T.result_line(F.col("doc_id"), F.lit(0.5))
    own = F.col("doc_id") % 3
    line = F.when(own == 0, T.result_line(F.col("doc_id"), F.lit(0.5), F.col("text"))).when(own == 1, plain).otherwise(F.concat(plain, F.lit(", Content: a, b")))
    return documents(spark, d).select("doc_id", T.parse_result_line(line)["parts"].cast("long").alias("parts"), T.line_kind(line).alias("kind"))


@query(O.bm25().rsplit("SELECT", 1)[0] + "SELECT rank, 'DocId: ' || doc_id || ', Score: ' || printf('%.6f', score) AS line FROM hits WHERE query_id = 0")
def search_line_result(spark, d):
    """The first benchmark text as a line over the wire."""
    text = asked(spark, d).filter("query_id = 0").first().text
    lines = console.answer(spark, saved_index(spark, d), f"{text}|1", TOP)
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "rank int, line string")


def _file(spark, rows: DataFrame, name: str) -> str:
    """rows(value) as text files."""
    path = shared_folder(spark, name)
    rows.write.text(path)
    return path


def _joined(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(F.concat_ws("\t", *[c.cast("string") for c in columns]).alias("value"))


@query(O.QRELS + "SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, rel FROM qrels")
def qrels_file(spark, d):
    """Judgements written as four columns and read back."""
    rows = vector_qrels(spark, d)
    return trec.read_qrels(spark, _file(spark, _joined(rows, F.col("query_id"), F.lit("0"), F.col("doc_id"), F.col("rel")), "qrels"))


@query(O.QRELS + "SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, rel FROM qrels")
def beir_qrels_file(spark, d):
    """Judgements as three columns under a header, with blank lines."""
    lines = _joined(vector_qrels(spark, d), F.col("query_id"), F.col("doc_id"), F.col("rel"))
    head = spark.createDataFrame([("query-id\tcorpus-id\tscore",), ("",)], "value string")
    return trec.read_beir_qrels(spark, _file(spark, head.unionByName(lines), "beir"))


@query("SELECT CAST(item_id AS VARCHAR) AS query_id, replace(text, chr(10), ' ') AS text FROM benchmark")
def queries_file(spark, d):
    """Query texts of one line each; a line without a tab is left out."""
    lines = _joined(asked(spark, d), F.col("query_id"), F.translate("text", "\n", " ")).unionByName(spark.createDataFrame([("no tab",)], "value string"))
    return collections.read_queries(spark, _file(spark, lines, "queries"))


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS query_id FROM conversations")
def query_ids_file(spark, d):
    """The ids of conversations, one line a turn; each once."""
    lines = _joined(read(spark, d, "conversations"), F.col("conv_id"), F.col("turn"))
    return collections.read_query_ids(spark, _file(spark, lines, "ids")).select("query_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS position FROM labels")
def ids_file(spark, d):
    """Labelled ids from the largest down, with their place in the file."""
    lines = read(spark, d, "labels").orderBy(F.desc("doc_id")).select(F.col("doc_id").cast("string").alias("value"))
    return collections.read_ids(spark, _file(spark, lines, "ids"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents")
def jsonl_file(spark, d):
    lines = documents(spark, d).select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), F.lit("t").alias("title"), "text")).alias("value"))
    return collections.read_jsonl(spark, _file(spark, lines, "jsonl"))


@query("SELECT url FROM (SELECT url FROM pages ORDER BY md5('1:' || url), url LIMIT 20)")
def seeds_file(spark, d):
    """Twenty of the seeds of a file with blank lines."""
    lines = pages(spark, d).select(F.col("url").alias("value")).unionByName(spark.createDataFrame([("",), ("  ",)], "value string"))
    return crawl.sample_seeds(collections.read_seeds(spark, _file(spark, lines, "seeds")), 20)


@query("SELECT source AS dataset, lang AS encoder, round(avg(n_chars), 4) AS map FROM documents GROUP BY source, lang")
def experiments_file(spark, d):
    """An experiment table as CSV with its header, read back."""
    path = shared_folder(spark, "experiments")
    value = F.round("value", 4)
    rows = _experiments(spark, d).select(
        F.col("dataset").alias("Dataset"), F.col("encoder").alias("Bi-Encoder"), F.lit("No").alias("Cross-Encoder"), F.lit("No").alias("Fine-Tuned"),
        value.alias("MAP"), *[F.lit(0.5).alias(c) for c in ("MRR", "NDCG@10", "NDCG@30", "Recall@10", "Recall@30")],
    )
    rows.write.csv(path, header=True)
    return collections.read_experiments(spark, path).select(F.col("Dataset").alias("dataset"), F.col("`Bi-Encoder`").alias("encoder"), F.col("MAP").alias("map"))


@query(O.VECTOR_RUN + "SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS dim, round(v[i], 6) AS value FROM (SELECT CAST(vec_id AS VARCHAR) AS vec_id, v FROM v), unnest(range(1, 65)) t(i)")
def vectors_file(spark, d):
    """Vectors written as Parquet and read by their schema."""
    path = shared_folder(spark, "vectors")
    vectors(spark, d).select(F.col("doc_id").cast("string").alias("id"), "embedding").write.parquet(path)
    return _parts(collections.read_vectors(spark, path), "id", F.col("embedding").cast("array<double>"))
