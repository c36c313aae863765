"""Queries of the training-data operators against their SQL twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.llm import catalog
from tests.oracle import connection, mismatch

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    assert mismatch(catalog.queries()[name](spark, SF), connection(SF), catalog.oracle_sql()[name]) is None


def test_chat_digests_equal_sql(spark):
    found = catalog.op7_chat_format(spark, SF).drop("formatted_chars")
    assert mismatch(found, connection(SF), catalog.OP7_DIGESTS) is None


def left_by_copies(rows):
    """What exact dedup, then the near-copy stage, keep of rows (doc_id, text), by brute force."""
    from tests.llm.test_copies import brute_components, normal

    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append((i is None, i or 0))
    first = {t: min(own) for t, own in groups.items()}
    seen, exact = set(), []
    for i, t in rows:
        if first[normal(t)] == (i is None, i or 0) and (i, normal(t)) not in seen:
            seen.add((i, normal(t)))
            exact.append((i, t))
    named = [(n, t) for n, (i, t) in enumerate(sorted(exact, key=lambda x: (x[0] is None, x[0] or 0)))]
    near = brute_components(named, 5, 80)
    ids = [i for i, _ in sorted(exact, key=lambda x: (x[0] is None, x[0] or 0))]
    # rows without a doc_id stay; a row goes if it is near to one of a smaller doc_id
    return [(ids[n], t) for n, t in named if ids[n] is None or ids[near[n][1]] == ids[n]]


def test_pipeline_equals_brute_force(spark):
    """Every stage on the rows that the one before it kept: by plain rules, and by the operators' own brute-force twins."""
    import corpus_pipeline
    from tests.llm.test_copies import normal
    from tests.llm.test_texts import plain_mix
    from tests.llm.test_tokens import check_packing, check_unpadded
    from heronlake.llm import packing

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400").withColumnRenamed("n_chars", "row")
    words = "the and of to in is that it was for on are as with they be at one have this from".split()
    base = " ".join(words * 4)
    odd = [(9000, base), (9001, base + " end"), (9002, base + "\n"), (9003, None), (9004, ""), (9005, "12 ## 34"), (None, base + " other end here"), (9006, base), (9006, base), (9007, "the and of " * 6000)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, 1) for i, t in odd], docs.schema)).repartition(6)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF).cache()
    kept = sorted(((r.doc_id, r.text) for r in known.collect()), key=str)
    gone = set(given) - set(kept)
    assert {(9003, None), (9004, ""), (9005, "12 ## 34")} <= gone and len(gone) <= 3 + len(given) // 50
    copied = stages["exact_dedup"](spark, known, SF).cache()
    near = stages["ngram_join"](spark, copied, SF).cache()
    got = [(r.doc_id, normal(r.text)) for r in near.collect()]
    assert sorted(got, key=str) == sorted(((i, normal(t)) for i, t in left_by_copies(kept)), key=str)
    mixed = stages["mixing"](spark, near, SF).cache()
    assert mixed.columns == near.columns == docs.columns
    rows = near.select("doc_id", "text", "source").collect()
    want = {k: sorted(v) for k, v in plain_mix([tuple(r) for r in rows]).items()}
    size = {r.doc_id: len((r.text or "").split()) for r in rows}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id, size[r.doc_id]] = taken.get((r.doc_id, size[r.doc_id]), 0) + len(r.text.split())
    assert taken == {k: sum(v) for k, v in want.items() if sum(v)}
    pieces = stages["packing"](spark, mixed.withColumn("doc_id", mixed["row"] * 0 + F.monotonically_increasing_id()), SF)
    numbered = mixed.withColumn("doc_id", mixed["row"] * 0 + F.monotonically_increasing_id()).select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in numbered], packing.WordEncoder(packing.vocabulary_path()).encode([r.text.encode() for r in numbered]), strict=True))
    ids = {k: [*np.frombuffer(v, "<u4").tolist(), 1] for k, v in ids.items()}
    check_unpadded(check_packing(pieces.collect(), ids, 2048, 2048))


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.run_on(spark, empty, SF).count() == 0


def test_the_first_two_texts_of_a_conversation_are_packed(spark):
    rows = catalog.op4_packing_instructions(spark, SF).collect()
    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'assistant'").count()
    assert sum(r.start + r.length == r.doc_tokens for r in rows) == turns
    assert any(r.loss_tokens < r.length for r in rows)
