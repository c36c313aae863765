"""Hand-checked cases of the retrieval, crawl, evaluation and training operators."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from heronlake.functions import text as T
from heronlake.functions import url as U
from heronlake.functions import vectors as V
from heronlake.operators import bm25, crawl, dense, evaluate, index, rerank, training
from heronlake.sources import collections as C
from heronlake.sources import trec
from heronlake.streaming import crawl_stream

DOCS = [(1, "The cat sat on the mat."), (2, "The dog chased the cat, the CAT ran."), (3, "Dogs and cats living together"), (4, "A quick brown fox; a lazy dog.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def ask(spark, docs, text, mode, **options):
    q = spark.createDataFrame([(0, text)], "query_id long, text string")
    return [(r.doc_id, round(r.score, 6)) for r in bm25.search(q, index.build(docs), mode, **options).orderBy("rank").collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_bm25(spark, docs):
    assert ask(spark, docs, "fox lazy", "or", floor_average=True) == [(4, 1.566433)]
    assert ask(spark, docs, "fox lazy", "and", floor_average=True) == [(4, 1.566433)]
    assert ask(spark, docs, "fox lazy", 1, length="bytes", floor_average=True) == [(4, 1.671023)]
    assert ask(spark, docs, "cat dog", "and") == [(2, 0.0)]
    assert ask(spark, docs, "cat dog", "or") == [(1, 0.0), (2, 0.0), (4, 0.0)]
    assert ask(spark, docs, "cat unknownterm", "and") == []
    assert ask(spark, docs, "Fox", "or", canonical=False) == []
    assert ask(spark, docs, "...", "or") == []
    twice, once = ask(spark, docs, "fox fox", "or")[0][1], ask(spark, docs, "fox", "or")[0][1]
    assert twice == pytest.approx(2 * once, abs=2e-6)
    with pytest.raises(ValueError):
        bm25.mode_of("xor")
    with pytest.raises(ValueError):
        bm25.search_text(spark, index.build(docs), "  ")
    assert bm25.search_text(spark, index.build(docs), "fox", docs=docs).first().content == DOCS[3][1]


def test_tokenizer(spark):
    text = F.lit("Más straße été foo_bar x y 42nd 你好 a")
    assert one(spark, T.index_tokens(text)) == ["m", "stra", "t", "foo", "bar", "x", "y", "42nd", "a"]
    assert one(spark, T.query_tokens(F.lit("A_b C"), canonical=False)) == ["A", "b", "C"]
    assert one(spark, T.query_tokens(F.lit("A_b C"), canonical=False, underscore=False)) == ["A_b", "C"]
    assert one(spark, T.between_tags(F.lit("a<t>in</t>b"), "<t>", "</t>")) == "in"
    assert one(spark, T.between_tags(F.lit("none"), "<t>", "</t>")) is None
    assert one(spark, T.first_line(F.lit("a\nb"))) == "a" and one(spark, T.strip_id_prefix(F.lit("7\ta\tb"))) == "a\tb"
    assert one(spark, T.with_prefix(F.lit(None), "query")) == "query: "


def test_index_round_trip(spark, docs, tmp_path):
    i = index.build(docs)
    index.create(docs, str(tmp_path / "i"))
    back = index.Index.load(spark, str(tmp_path / "i"))
    assert sorted(back.lexicon.collect()) == sorted(i.lexicon.collect()) and back.corpus().collect() == i.corpus().collect()
    asks = spark.createDataFrame([(0, "fox lazy dog cat unknown"), (1, "the")], "query_id long, text string")
    for mode in ("or", "and"):
        assert bm25.search(asks, back, mode).collect() == bm25.search(asks, i, mode).collect()
    rows = lambda d: sorted(map(tuple, d.select("term", "doc_id", "tf").collect()))
    assert rows(back.postings) == rows(i.postings) == rows(index.parse_lines(index.merged_lines(i.postings)))
    total = i.postings.agg(F.sum("tf")).first()[0]
    assert total == docs.select(F.sum(F.size(T.index_tokens(F.col("text"))))).first()[0]
    assert {r.doc_id: r.word_count for r in i.doc_stats.collect()} == {1: 5, 2: 5, 3: 5, 4: 6}
    big = spark.range(300).select(F.lit("t").alias("term"), (F.col("id") * 3).alias("doc_id"), F.lit(1).alias("tf"))
    restored = index.restored(index.chunked(big))
    assert restored.filter("doc_id <> restored_id").count() == 0 and restored.agg(F.max("chunk")).first()[0] == 4
    assert index.blocks(index.chunk_metadata(big), 200).first().n_blocks > 1
    empty = spark.createDataFrame([(9, None), (10, "...")], "doc_id long, text string")
    assert sorted(r.word_count for r in index.build(docs.unionByName(empty)).doc_stats.collect())[:2] == [0, 0]


def test_a_line_is_read_once_and_not_once_a_posting(spark):
    lines = spark.createDataFrame([("a:b:3 1,12 2",), ("c:0 7",)], "line string")
    found = index.parse_lines(lines)
    assert sorted(map(tuple, found.collect())) == [("a:b", 3, 1), ("a:b", 12, 2), ("c", 0, 7)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()  # from the top down
    assert plan.index("Generate explode") < plan.index("reverse(line")


def test_terms_are_pushed_down_to_the_saved_postings(spark, docs, tmp_path, monkeypatch):
    saved = index.create(docs, str(tmp_path / "i"))
    asks = spark.createDataFrame([(0, "fox lazy")], "query_id long, text string")
    found = bm25.search(asks, saved)
    plan = found._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "FileScan parquet" in line and "tf#" in line]
    assert pushed and all("In(term, [fox,lazy])" in line and "data_length" not in line.split("ReadSchema")[1] for line in pushed)
    want = sorted(found.collect())
    monkeypatch.setattr(bm25, "PUSHED_TERMS", 1)
    assert sorted(bm25.search(asks, saved).collect()) == want


def test_console_answers_lines(spark, docs, tmp_path):
    import io

    from heronlake import console

    saved, out = index.create(docs, str(tmp_path / "i")), io.StringIO()
    console.loop(spark, saved, ["fox lazy|0\n", "unknown|or\n", "no mode\n", "fox|xor\n", " |1\n", "a|b fox|1\n", "exit\n", "fox|1\n"], out, docs=docs)
    lines = out.getvalue().splitlines()
    assert lines[0].startswith("DocId: 4, Score: 1.6") and lines[0].endswith("Content: A quick brown fox; a lazy dog.")
    assert lines[1:5] == ["no match", "no mode in the line", "unknown mode 'xor'", "empty query"] and lines[5].startswith("DocId: 4") and len(lines) == 6


def test_frequent_terms_are_chunked_over_ranges(spark, monkeypatch):
    rows = spark.range(500).select(F.lit("t").alias("term"), (F.col("id") * 3).alias("doc_id"), F.lit(1).alias("tf"))
    whole = sorted(index.chunked(rows).collect())
    monkeypatch.setattr(index, "RANGE", 100)
    assert sorted(index.chunked(rows).collect()) == whole and max(r.chunk for r in whole) == 7


def test_metrics(spark):
    run = spark.createDataFrame([("q", d, 4.0 - i) for i, d in enumerate(["d1", "d2", "d3", "d4"])] + [("other", "d1", 1.0)], "query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", "d1", 2), ("q", "d3", 1), ("q", "d5", 1)], "query_id string, doc_id string, rel int")
    m = evaluate.per_query(run, qrels, (4, 5)).collect()
    assert len(m) == 1
    assert (m[0].ndcg_4, m[0].map, m[0].recip_rank, m[0].p_5, m[0].recall_5) == (0.798485, 0.555556, 1.0, 0.4, 0.666667)
    assert evaluate.mrr(run, qrels).first().mrr == 0.5
    perfect = qrels.select("query_id", "doc_id", F.col("rel").cast("double").alias("score"))
    assert evaluate.per_query(perfect, qrels, (5,)).first().ndcg_5 == 1.0
    assert '"map":"0.5556"' in evaluate.metrics_json(evaluate.per_query(run, qrels, (5,))).first().metrics
    tied = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0)], run.schema)
    assert [r.doc_id for r in evaluate.judged(tied, qrels).orderBy("rank").collect()] == ["b", "a"]


def test_urls(spark):
    u = F.lit("https://www.a.co.nz/x/?q=1#f")
    assert one(spark, U.normalize(u)) == "https://www.a.co.nz/x/" and one(spark, U.minimize(u)) == "//a.co.nz/x"
    assert one(spark, U.domain(u)) == "www.a.co.nz" and one(spark, U.second_last(U.domain(u))) == "co"
    assert one(spark, U.second_last(F.lit("localhost"))) is None
    for url, good in (("https://a.nz/p", True), ("https://a.nz/p.PDF", False), ("https://a.nz:8080/p", False), ("https://A.NZ/p", False)):
        assert one(spark, U.is_valid(F.lit(url))) is good
    bases = ["http://h.org/a/b/c?x=1#f", "http://h.org", "https://h.org/d/"]
    refs = ["http://o.net/p", "//o.net/p", "/r", "?q=2", "#g", "", "g", "./g", "../g", "../../g", "g/./h/..", "g?y/../x", "mailto:a@b.c", "/a/../b/./c", "../../../g"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string").select("b", "r", U.join_url(F.col("b"), F.col("r")).alias("j")).collect()
    assert [(x.b, x.r, x.j) for x in rows] == [(x.b, x.r, urljoin(x.b, x.r)) for x in rows]


def test_priorities(spark):
    value = lambda e, i, label, v: one(spark, U.final_priority(U.domain_priority(F.lit(e)), U.in_degree_priority(F.lit(i)), U.second_last_priority(F.lit(label), F.lit(v))))
    assert value(0, 0, "co", 0) == 206 and value(3, 2, "co", 10) == 379


def test_crawl(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.org/", '<a href="/x">x</a><A class=k HREF=\'http://b.org/y#z\'>y</A><a href="/x">x</a>'), (2, "http://a.org/x", '<a href="/">up</a><a href="http://b.org/f.pdf">f</a>')],
        "page_id long, url string, html string",
    )
    e = crawl.edges(pages)
    assert sorted(r.dst_url for r in e.collect()) == ["http://a.org/", "http://a.org/x", "http://b.org/f.pdf", "http://b.org/y"]
    assert {r.domain: (r.enqueue_count, r.in_degree) for r in crawl.domain_counters(e).collect()} == {"a.org": (1, 0), "b.org": (1, 2)}
    visits = crawl.breadth_first(e, spark.createDataFrame([("http://www.a.org",)], "url string"), suffix=".org").orderBy("visit_order").collect()
    assert [(r.min_url, r.depth) for r in visits][0] == ("//a.org", 0)
    assert {r.min_url: r.depth for r in visits} == {"//a.org": 0, "//a.org/x": 1, "//b.org/y": 1}  # www.a.org is the page //a.org
    visits = crawl.breadth_first(e, pages.select("url").limit(1), suffix=".org").collect()
    assert {r.min_url for r in visits} == {"//a.org", "//a.org/x", "//b.org/y"}
    assert crawl.totals(spark.createDataFrame([], "size long, status string")).first().average_kb == 0.0
    robots = spark.createDataFrame([("http://a.org/robots.txt", "User-agent: *\nDisallow: /x")], "robots_url string, text string")
    allowed = crawl.robots_allowed(pages.select("url").union(spark.createDataFrame([("http://c.org/x",)], "url string")), robots)
    assert {r.url: r.allowed for r in allowed.collect()} == {"http://a.org/": True, "http://a.org/x": False, "http://c.org/x": True}
    seen = crawl.follow_redirects(pages.select("url"), spark.createDataFrame([("http://a.org/x", "http://b.org/new")], "url string, final_url string"))
    assert {r.min_url for r in seen.collect()} == {"//a.org", "//a.org/x", "//b.org/new"}
    log = spark.createDataFrame([("u", 5, "t", "200", 0, 1, None, True)], "url string, size long, time string, status string, depth int, order long, redirect_url string, is_seed boolean")
    assert crawl.log_lines(log).first().line == "Depth: 0, Status: 200, (seed)URL: u, Time: t, Size: 5 bytes"
    kinds = spark.createDataFrame([("200", "text/html; charset=x"), ("200", "image/png"), ("Timeout", None)], "status string, content_type string")
    assert [r.o for r in kinds.select(crawl.outcome().alias("o")).collect()] == ["200", "MIME Type Not HTML", "Timeout"]


def test_crawls_remember_counters_and_take_first_in_first_out(spark):
    rows = [(1, "http://a.org/", "".join(f'<a href="http://a.org/{i}">x</a>' for i in (9, 3, 7, 1)) + '<a href="http://b.org/x">b</a>'), (2, "http://a.org/9", '<a href="http://b.org/y">b</a><a href="http://c.org/z">c</a>'), (3, "http://b.org/x", '<a href="http://c.org/w">c</a>')]
    e = crawl.edges(spark.createDataFrame(rows, "page_id long, url string, html string"))
    seeds = spark.createDataFrame([("http://a.org/",)], "url string")
    visits = [r.min_url for r in crawl.breadth_first(e, seeds, rounds=4, per_round=10).orderBy("visit_order").collect()]
    # b.org is linked from another host, which puts it first; pages of one priority follow their places on the page
    assert visits[:6] == ["//a.org", "//b.org/x", "//a.org/9", "//a.org/3", "//a.org/7", "//a.org/1"]
    assert set(visits[6:]) == {"//b.org/y", "//c.org/z", "//c.org/w"}
    to = spark.createDataFrame([("http://a.org/9", "http://b.org/x"), ("http://a.org/3", "ftp://bad.net/p.pdf"), ("http://a.org/7", "http://d.org/new")], "url string, final_url string")
    found = {r.url: r.outcome for r in crawl.redirect_outcomes(spark.createDataFrame([(f"http://a.org/{i}",) for i in (9, 3, 7, 1)], "url string"), to, spark.createDataFrame([("//b.org/x",)], "min_url string"), ".org").collect()}
    assert found == {"http://a.org/9": "seen", "http://a.org/3": "invalid", "http://a.org/7": "followed", "http://a.org/1": "direct"}
    to = spark.createDataFrame([("http://a.org/", "http://a.org/9")], "url string, final_url string")
    moved = crawl.breadth_first(e, seeds, redirects=to).orderBy("visit_order").collect()
    assert {r.min_url for r in moved} == {"//a.org", "//b.org/y", "//c.org/z"}  # the target's links, and the target itself is seen


def test_crawl_files(spark, tmp_path):
    log = spark.createDataFrame([("http://a.org/u", 5, "t", "200", 0, 1, None, True), ("http://b.org/", 7, "t", "404", 1, 2, "http://c.org/", False)], "url string, size long, time string, status string, depth int, order long, redirect_url string, is_seed boolean")
    path = crawl.write_log(log, spark.createDataFrame([("//x",)], "min_url string"), str(tmp_path), "2024-01-01-00-00-00", 1.5)
    assert path.endswith("crawl-2024-01-01-00-00-00") and spark.read.text(f"{path}/log").count() == 2
    lines = [r.value for r in spark.read.text(f"{path}/statistics").collect()]
    assert lines[:3] == ["total_pages: 2", "successful_pages: 1", "total_bytes: 12"] and {"n_redirects: 1", "n_domains: 2", "queue_size: 1", "seconds: 1.500"} <= set(lines)


def test_hashed_index_is_written_once_and_finds_enough(spark, tmp_path):
    corpus = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as doc_id", "embedding")
    asks = corpus.filter("doc_id % 100 = 0").selectExpr("doc_id as query_id", "embedding as vector")
    saved = dense.HashedIndex.build(corpus).save(str(tmp_path / "h"))
    assert dense.recall(saved.search(asks, 20), dense.exact_top_k(asks, corpus, 20)).first().recall >= 0.9
    few = saved.search(asks.limit(2), 1990)  # more than any query's candidates: exact
    assert few.groupBy("query_id").count().filter("count <> 1990").isEmpty()


def test_queries_go_through_in_slices(spark, monkeypatch):
    corpus = spark.range(40).selectExpr("id as doc_id", "array(cast(id as double), 1.0D) as embedding")
    asks = corpus.selectExpr("doc_id as query_id", "embedding as vector")
    whole = sorted(dense.exact_top_k(asks, corpus, 3).collect())
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", 7)
    found = dense.exact_top_k(asks, corpus, 3)
    assert sorted(found.collect()) == whole and "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_training(spark, docs):
    qrels = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 99, 1), (7, 1, 1)], "query_id long, doc_id long, rel int")
    queries = spark.createDataFrame([(0, "cat")], "query_id long, text string")
    assert [(r.query_id, r.doc_id) for r in training.positives(qrels, queries, docs).collect()] == [(0, 1)]
    assert {r.doc_id for r in training.negative_candidates(qrels, queries, docs).collect()} == {3, 4}
    drawn = training.negatives(qrels, queries, docs, 10, digits=1)
    assert {r.doc_id for r in drawn.collect()} <= {3, 4} and drawn.count() > 0
    rows = training.examples(qrels, queries, docs)
    assert training.limited(rows, 1, 1).count() <= 2 and {r.label for r in training.label_counts(rows).collect()} <= {0, 1}


def test_each_query_gets_all_its_negatives(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"))
    queries = spark.createDataFrame([(q, "x") for q in range(4)], "query_id long, text string")
    judged = [(0, d, 1 if d < 3 else 2) for d in range(40)] + [(1, d, 1) for d in range(25)] + [(1, 30, 0), (2, 5, 2), (3, 999, 1), (9, 1, 1)]
    qrels = spark.createDataFrame(judged, "query_id long, doc_id long, rel int")
    for digits in (0, 1, 3):
        rows = [(r.query_id, r.doc_id) for r in training.negatives(qrels, queries, docs, digits=digits).collect()]
        assert len(rows) == len(set(rows)) and not set(rows) & {(q, d) for q, d, _ in judged}
        # 10 for each positive, judged or not in the table; 250 of query 1's 274 candidates; none without positives
        assert {q: sum(x == q for x, _ in rows) for q in range(4)} == {0: 30, 1: 250, 2: 0, 3: 10}
    rows = training.negatives(qrels, queries, docs, ratio=20).filter("query_id = 1").collect()
    assert sorted(r.doc_id for r in rows) == [d for d in range(300) if d >= 25 and d != 30]
    assert training.negatives(qrels, queries, docs.limit(0)).count() == 0


def test_vectors(spark, docs):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.dot(a, a)) == 25.0 and one(spark, V.squared_l2(a, b)) == 25.0
    assert one(spark, V.l2_normalise(a)) == [0.6, 0.8] and one(spark, V.l2_normalise(b)) == [0.0, 0.0]
    assert one(spark, V.inverse_distance(F.lit(0.0))) == 1e9
    assert one(spark, V.mean_pool(F.array(a, b, a), F.array(F.lit(1), F.lit(1), F.lit(0)))) == [1.5, 2.0]
    corpus = rerank.encode(docs)
    queries = rerank.encode(docs.select(F.col("doc_id").alias("query_id"), "text")).withColumnRenamed("embedding", "vector")
    best = dense.exact_top_k(queries, corpus, 1).collect()
    assert {r.query_id: r.doc_id for r in best} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert rerank.missing_vectors(dense.exact_top_k(queries, corpus, 2), corpus.filter("doc_id > 1")).count() > 0


def test_sources(spark, tmp_path):
    (tmp_path / "docs.tsv").write_text("1\ta\tb\n 2 \tc\nx\td\nnotab\n99999999999999999999\te\n")
    good, bad = C.read_passages(spark, str(tmp_path / "docs.tsv"))
    assert sorted(map(tuple, good.collect())) == [(1, "a\tb"), (2, "c")] and bad.count() == 3
    (tmp_path / "ids").write_text("5\n3\n")
    assert sorted(map(tuple, C.read_ids(spark, str(tmp_path / "ids")).collect())) == [(3, 1), (5, 0)]
    (tmp_path / "q.tsv").write_text("q1\tone\nq2\nq1\tagain\n")
    assert C.read_queries(spark, str(tmp_path / "q.tsv")).count() == 2 and C.read_query_ids(spark, str(tmp_path / "q.tsv")).count() == 2
    (tmp_path / "c.jsonl").write_text('{"_id": "a", "title": "t", "text": "x"}\n{"_id": "b"}\n')
    assert sorted(map(tuple, C.read_jsonl(spark, str(tmp_path / "c.jsonl")).collect())) == [("a", "x"), ("b", "")]
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t1\n\nq\td\t2\n")
    assert [tuple(r) for r in trec.read_beir_qrels(spark, str(tmp_path / "qrels.tsv")).collect()] == [("q", "d", 2)]
    (tmp_path / "t.qrels").write_text("q\t0\td\t1\nq\t0\td\t0\n")
    assert [r.rel for r in trec.read_qrels(spark, str(tmp_path / "t.qrels")).collect()] == [0]
    run = spark.createDataFrame([("q", "d", 0.5, 1), ("q", "e", 0.25, 2)], "query_id string, doc_id string, score double, rank int")
    trec.write_run(run, str(tmp_path / "run"), "run1")
    assert trec.read_run(spark, str(tmp_path / "run")).count() == 2 and trec.read_run(spark, str(tmp_path / "run"), 1).first().doc_id == "d"
    (tmp_path / "seeds").write_text("http://a\n\nhttp://b\n")
    assert crawl.sample_seeds(C.read_seeds(spark, str(tmp_path / "seeds")), 5).count() == 2
    import numpy as np

    np.save(tmp_path / "v.npy", np.eye(3, dtype=np.float32))
    C.convert_npy(spark, str(tmp_path / "v.npy"), [7, 8, 9], str(tmp_path / "v"), rows=2)
    assert {r.id: r.embedding.index(1.0) for r in C.read_vectors(spark, str(tmp_path / "v")).collect()} == {"7": 0, "8": 1, "9": 2}


def test_streams(spark, tmp_path):
    rows = [("http://a.org/x", "2024-01-01 00:00:00"), ("http://www.a.org/x/", "2024-01-01 00:00:01"), ("http://a.org/y", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "url string, ts string").select("url", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(once=True).start()
        assert q.awaitTermination(90)
        return spark.table(name).collect()

    assert len(drain(crawl_stream.first_visits(stream()), "firsts")) == 2
    placed = sorted(r.visit_at - 1704067200 for r in drain(crawl_stream.schedule(stream()), "placed") if r.domain == "a.org")
    assert placed == [0.0, 2.0]


def test_a_visit_is_given_out_once_however_late_it_repeats(spark, tmp_path):
    for day in (1, 5, 9):  # each run reads one more file; the watermark passes between them
        rows = [("http://a.org/x", f"2024-01-0{day} 00:00:00"), (f"http://a.org/{day}", f"2024-01-0{day} 00:00:00")]
        spark.createDataFrame(rows, "url string, ts string").select("url", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = crawl_stream.first_visits(spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    assert sorted(r.min_url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["//a.org/1", "//a.org/5", "//a.org/9", "//a.org/x"]


@pytest.mark.parametrize("run", [4, 200_000])
def test_a_host_of_many_batches_is_scheduled_in_one_order(spark, tmp_path, monkeypatch, run):
    monkeypatch.setattr(crawl_stream, "RUN", run)
    rows = [(f"http://a.org/{i % 7}", 1704067200 + (i * 37) % 50) for i in range(50)]
    spark.createDataFrame(rows, "url string, s long").select("url", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = [(r.wanted_at, r.url, r.visit_at) for r in crawl_stream.drain(crawl_stream.schedule(stream)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, last = [], 0.0
    for url, at in sorted(rows, key=lambda r: (r[1], r[0])):
        last = max(float(at), last + 2)
        want.append((float(at), url, last))
    assert sorted(found) == want


def test_order_over_spilled_runs_equals_one_sort(monkeypatch):
    import random

    import pandas as pd

    monkeypatch.setattr(crawl_stream, "PIECE", 3)
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "é", None]), "d", r.choice([0.0, 1.0, 2.5, float("nan")])) for _ in range(40)]
    frame = pd.DataFrame(rows, columns=["url", "domain", "wanted_at"])
    batches = lambda: (frame.iloc[at : at + 4] for at in range(0, 40, 4))
    whole, parts = (pd.concat(crawl_stream._in_order(batches(), run), ignore_index=True) for run in (10**6, 8))
    assert whole.fillna("-").values.tolist() == parts.fillna("-").values.tolist()


def test_case_keeping_query_tokens_equal_their_sql_twin(spark):
    import duckdb

    from heronlake.plans import oracles

    texts = ["für Über Más straße", "«x» 10¼ a·b c¼d", "The CAT naïve Àb foo_bar", "", None, "Ú÷Ý x-y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    ascii_only = lambda ts: [t for t in ts if t.isascii() and "\x01" not in t]
    got = {r.i: ascii_only(r.ts) for r in rows.select("i", T.query_tokens(F.col("text"), False).alias("ts")).collect()}
    one = lambda t: duckdb.execute(f"SELECT {oracles.cased_tokens('x')} FROM (SELECT ?::VARCHAR AS x)", [t]).fetchone()[0]
    assert got == {i: ascii_only(one(t)) for i, t in enumerate(texts)}
    assert got[0] == ["r", "ber"]


def test_negatives_are_spread_out_of_blocks(spark, monkeypatch):
    queries, docs = spark.range(7).select(F.col("id").alias("query_id")), spark.range(100).select(F.col("id").alias("doc_id"))
    qrels = queries.crossJoin(docs).filter("doc_id % 11 = query_id or doc_id % 23 = query_id").selectExpr("query_id", "doc_id", "int(1 + doc_id % 3) as rel")
    qrels = qrels.unionByName(qrels.filter("query_id = 3"))  # judged twice
    drawn = lambda: sorted((r.query_id, r.doc_id) for r in training.negatives(qrels, queries, docs, ratio=5).collect())
    whole = drawn()
    counts = {r.query_id: min(5 * r.n, 100 - r.judged) for r in qrels.groupBy("query_id").agg(F.count_if(F.col("rel") == 1).alias("n"), F.countDistinct("doc_id").alias("judged")).collect()}
    assert {q: sum(x == q for x, _ in whole) for q in counts} == counts and len(set(whole)) == len(whole)
    assert not set(whole) & {(r.query_id, r.doc_id) for r in qrels.collect()}
    plan = training.negatives(qrels, queries, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "div 1024" in plan.split("Generate explode(sequence(")[1].splitlines()[0]  # a row per block and not per step
    for block, few in ((8, 1000), (3, 0)):
        monkeypatch.setattr(training, "BLOCK", block)
        monkeypatch.setattr(training, "BROADCAST_ROWS", few)
        assert drawn() == whole


def test_searches_in_blocks_equal_the_plain_one(spark, monkeypatch):
    import numpy as np

    from heronlake.operators import nearest

    draw = np.random.default_rng(5)
    rows = [(i, [round(float(x), 2) for x in draw.standard_normal(6)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)] + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [1.0]), (2003, [float("nan")] * 6), (2004, [1e300] * 6)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)
    asks = corpus.filter("doc_id % 50 = 0 or doc_id between 1998 and 2005").selectExpr("doc_id as query_id", "embedding as vector")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
    monkeypatch.setattr(nearest, "QUERY_ROWS", 4)
    monkeypatch.setattr(nearest, "CORPUS_ROWS", 64)
    for metric in ("dot", "l2", "inverse"):
        plain = bm25.top_k(dense.exact_scores(asks, corpus, metric), 5)
        found = dense.exact_top_k(asks, corpus, 5, metric)
        assert same(found, plain)
        assert dense.HashedIndex.build(corpus).search(asks, 363).count() == asks.count() * 363  # exact where candidates are few
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "BroadcastNestedLoopJoin" not in dense._in_blocks(asks, corpus, 5, "dot", 6)._jdf.queryExecution().toString()
    values = [0.1234567885, -0.1234567885, 2.5e-9, -0.5e-9, 1.0000000005, 3e6 + 1.5e-9, 123456.7890123455, 0.0]
    want = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 9)).collect()
    assert [float(v) + 0.0 for v in nearest.rounded(np.array(values))] == [r[0] for r in want]


def test_judgements_are_counted_and_not_sorted(spark, monkeypatch):
    run = spark.createDataFrame([(q, d, float(-d)) for q in ("a", "b", "c", "d") for d in range(6)], "query_id string, doc_id long, score double")
    rels = [("a", 0, 3), ("a", 2, 1), ("a", 9, 2)] + [("b", 100 + i, 1) for i in range(300)] + [("b", 1, 2), ("c", 1, 0), ("c", 2, 0), ("x", 1, 1)]
    qrels = spark.createDataFrame(rels, "query_id string, doc_id long, rel int")
    m = {r.query_id: r for r in evaluate.per_query(run, qrels, (5, 100)).collect()}
    assert set(m) == {"a", "b", "c"} and (m["c"].map, m["c"].ndcg_5, m["c"].recall_5, m["c"].recip_rank) == (0, 0, 0, 0)
    assert (m["a"].recall_5, m["a"].map, m["a"].ndcg_5) == (0.666667, 0.555556, 0.735007)
    assert (m["b"].recip_rank, m["b"].recall_5) == (0.5, 0.003322) and 0 < m["b"].ndcg_100 < m["b"].ndcg_5
    plan = evaluate.per_query(run, qrels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1  # of the run; judgements are not numbered
    mrr = evaluate.mrr(run, qrels).first().mrr
    assert mrr == 0.375  # (1 + 1 / 2 + 0 + 0) / 4
    monkeypatch.setattr(evaluate, "BROADCAST_ROWS", 1)
    assert {r.query_id: r for r in evaluate.per_query(run, qrels, (5, 100)).collect()} == m and evaluate.mrr(run, qrels).first().mrr == mrr


def test_numbers_as_bytes(spark):
    rows = [(0, [0, 127, 128, 300]), (1, []), (2, None), (3, [5, None]), (4, [(1 << 63) - 1, 1 << 56, 16383, 16384]), (5, [7])]
    coded = spark.createDataFrame(rows, "i int, v array<long>").select("i", "v", index.varbyte_encode(F.col("v")).alias("b"))
    found = {r.i: r for r in coded.select("*", index.varbyte_decode(F.col("b")).alias("w"), F.size("b").alias("n")).collect()}
    assert found[0].b == [0, 127, 128, 1, 172, 2] and found[1].b == [] and found[2].b is None and found[3].b is None
    assert all(found[i].w == found[i].v for i in (0, 1, 2, 4, 5)) and found[4].n == 9 + 9 + 2 + 3
    cut = spark.createDataFrame([(0, [129]), (1, [1, 200]), (2, [3])], "i int, b array<int>").select("i", index.varbyte_decode(F.col("b")).alias("w"))
    assert {r.i: r.w for r in cut.collect()} == {0: [], 1: [1], 2: [3]}
    plan = found and coded._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan  # no interpreted steps per byte


def test_chunks_take_one_sort_of_the_postings(spark, monkeypatch):
    rows = spark.range(500).selectExpr("if(id % 3 = 0, 's', 't') as term", "id * 7 as doc_id", "1 as tf")
    found = index.chunked(rows)
    whole = sorted(found.collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("order by") == 0 and "chunk" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x)
    monkeypatch.setattr(index, "RANGE", 90)
    assert sorted(index.chunked(rows).collect()) == whole and index.order_violations(rows).isEmpty()


def test_tokens_are_counted_by_bytes_as_by_columns(spark):
    odd = "".join(map(chr, range(1, 0x250))) + " \u2028x\u00a0y A_b-C 0z \x7fq \x01r 你好a été \ufb01n"
    texts = [odd, " ".join(odd), "Ab ab AB", "", None, "...", "a" * 5000, "x\u0101y X\u0101Y"] + [f"w{i} " * 3 for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = docs.select("doc_id", F.explode(T.index_tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))
    found = index.term_frequencies(docs)
    assert sorted(found.collect()) == sorted(want.collect()) and "MapInArrow" in found._jdf.queryExecution().toString()
    stats = {r.doc_id: (r.data_length, r.word_count) for r in index.document_stats(docs).collect()}
    words = {r.doc_id: r.n for r in want.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert stats == {i: (len((t or "").encode()), words.get(i, 0)) for i, t in enumerate(texts)}
    twice = spark.createDataFrame([(1, "b a"), (2, "c"), (1, "a")], "doc_id long, text string")
    assert sorted(map(tuple, index.term_frequencies(twice).collect())) == [("a", 1, 2), ("b", 1, 1), ("c", 2, 1)]


def test_weights_are_added_up_in_blocks(spark, monkeypatch):
    from heronlake.operators import adding

    texts = [" ".join(f"w{(i * j) % 13}" for j in range(1, 2 + i % 9)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asks = spark.createDataFrame([(q, f"w{q % 13} w{q * 5 % 13} w1 w1") for q in range(30)] + [(40, "none"), (41, "")], "query_id long, text string")
    built = index.build(docs)
    monkeypatch.setattr(adding, "CELLS", 200)
    for mode in ("or", "and"):
        found = bm25.search(asks, built, mode, 7)
        want = bm25.top_k(bm25.score(asks, built, mode), 7)
        assert sorted(found.collect()) == sorted(want.select(found.columns).collect()) and found.count() > 0
    assert "MapInArrow run" in found._jdf.queryExecution().toString()
    monkeypatch.setattr(bm25, "PUSHED_TERMS", 1)  # more terms than may go with the function
    assert sorted(bm25.search(asks, built, "and", 7).collect()) == sorted(found.collect())
