"""Chat windows read back, and vector search against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heronlake.llm import chat_format, vector_tree

SCHEMA = "conv_id long, turn long, role string, text string, block string"


def talks(seed=1):
    r = random.Random(seed)
    rows = []
    for conv in range(30):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "be [INST] kind \\b\\l" * r.randrange(3), "x"))
        n = r.choice([1, 3, 8, 40, 700 if conv == 5 else 2])
        for t in range(1, n + 1):
            text = r.choice(["</s>[INST] ok [/INST]", "\\", "\\l<[", "é😀 word " * r.randrange(60), "many words here " * (500 if r.random() < 0.02 else 9), None])
            rows.append((conv, t if conv % 7 else 3, r.choice(["user", "assistant", None, "assistant"]), text, "x"))
    return rows + [(None, None, None, None, "x"), (77, 0, "system", "alone", "x"), (78, None, "assistant", "last", "x"), (78, 5, "user", "first", "x"), (78, 5, "user", "first", "x")]


def in_order(rows):
    def place(x):
        role, text = x[1], x[2]
        h = xxhash.xxh64(text, seed=xxhash.xxh64(role, seed=42).intdigest()).intdigest()
        return x[0], role[:64], text[:64], h - (1 << 64) * (h >> 63)

    return sorted((((1 << 63) - 1 if x[1] is None else x[1], x[2] or "", x[3] or "") for x in rows), key=place)


def digests(rows):
    want = {}
    for conv in {x[0] for x in rows}:
        own = in_order(x for x in rows if x[0] == conv)
        loss = "".join(t for _, r, t in own if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        want[conv] = (len(own), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return want


@pytest.mark.parametrize("block", [64, 1])
def test_windows_read_back(spark, monkeypatch, block):
    monkeypatch.setattr(chat_format, "BLOCK", block)
    rows = talks()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(docs).collect()}
    assert got == digests(rows)


def plain_windows(turns, budget, history, block):
    """Windows of one conversation's turns in order: (repeated turns, new turns, tokens)."""
    size = [len(re.findall(r"\w+|[^\w\s]", t)) + 4 for _, _, t in turns]
    before = [sum(size[:i]) for i in range(len(turns))]
    system = turns[0][1] == "system"
    fixed = size[0] if system else 0
    room = max(1, budget - history - fixed)
    out = []
    for i in range(1 if system else 0, len(turns)):
        if out and before[i] // block == before[out[-1][0]] // block and sum(size[j] for j in out[-1]) + size[i] <= room:
            out[-1].append(i)
        else:
            out.append([i])
    found = []
    for nth, own in enumerate(out or [[]]):
        n, past = sum(size[j] for j in own), []
        spare = min(history, budget - fixed - n)
        for j in range((own or [0])[0] - 1, 0 if system else -1, -1):
            if sum(size[x] for x in past) + size[j] > spare:
                break
            past.insert(0, j)
        lead = [0] * (system and nth > 0) + past
        found.append((len(lead), [0] * (system and nth == 0) + own, fixed + n + sum(size[j] for j in past)))
    return found


@pytest.mark.parametrize("block", [1, 64])
def test_windows_equal_a_plain_scan(spark, monkeypatch, block):
    monkeypatch.setattr(chat_format, "BLOCK", block)
    rows = talks(2)
    got = {}
    for r in chat_format.format_windows(spark.createDataFrame(rows, SCHEMA).repartition(5), 300, 80).collect():
        got.setdefault(r.conv_id, []).append(((r.block, r.window), r.n_context, r.n_new, r.n_tokens, r.over_budget, r.formatted))
    assert set(got) == {x[0] for x in rows}
    for conv, own in got.items():
        turns = in_order(x for x in rows if x[0] == conv)
        want = plain_windows(turns, 300, 80, block * 300)
        own.sort()
        assert [(c, n, t, over) for _, c, n, t, over, _ in own] == [(c, len(new), t, t > 300) for c, new, t in want]
        for (_, c, n, _, _, formatted), (_, new, _) in zip(own, want, strict=True):
            said = [p.split("[/INST]") for p in formatted.split("</s>")[:-1]]
            code = lambda x: x.replace("\\", "\\b").replace("<", "\\l").replace("[", "\\i")
            assert [(r[6:], t) for r, t in said[c:]] == [(code(turns[i][1]), code(turns[i][2])) for i in new]
    assert any(x[1] > 1 for own in got.values() for x in own)
    if block == 1:
        assert max(key[0] for own in got.values() for key, *_ in own) > 5


def test_only_the_order_of_turns_counts(spark):
    def windows(numbers):
        rows = [(1, n, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i % 11), "x") for i, n in enumerate(numbers)]
        found = chat_format.format_windows(spark.createDataFrame(rows, SCHEMA), 64, 16).collect()
        return sorted((r.block, r.window, r.n_context, r.n_new, r.formatted, r.n_tokens) for r in found)

    dense = windows(range(300))
    assert dense == windows([i * 1000 - 7 for i in range(300)]) and len(dense) > 20


def test_history_shrinks_before_the_budget_is_exceeded(spark):
    docs = spark.createDataFrame([(1, 0, "user", "w " * 46, "x"), (1, 1, "assistant", "w " * 256, "x"), (1, 2, "user", "w " * 400, "x"), (1, 3, "user", "w", "x")], SCHEMA)
    rows = sorted(chat_format.format_windows(docs, 300, 80).collect(), key=lambda r: r.window)
    assert [(r.n_context, r.n_new, r.n_tokens, r.over_budget) for r in rows] == [(0, 1, 50, False), (0, 1, 260, False), (0, 1, 404, True), (0, 1, 5, False)]


def test_token_column_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, i, "assistant", "é ü", "x") for i in range(10)], SCHEMA).selectExpr("*", "100L as n", "1 as turns", "2 as at", "3 as h", "4 as tokens")
    rows = chat_format.format_windows(docs, 300, 0, tokens="n").collect()
    assert [r.n_new for r in sorted(rows, key=lambda r: r.window)] == [3, 3, 3, 1]
    assert chat_format.format_windows(docs, 300, 0).collect()[0].n_tokens == 60


def test_many_equal_turns_end_soon(spark):
    """20,000 turns of one number, a third of them equal, and one very long text."""
    docs = spark.range(20_000).selectExpr("1L as conv_id", "cast(null as long) as turn", "'assistant' as role", "if(id % 3 = 0, 'same', concat('text ', id)) as text")
    docs = docs.unionByName(spark.createDataFrame([(2, 0, "assistant", "long [words] " * 100_000)], docs.schema))
    began = time.time()
    rows = {r.conv_id: r for r in chat_format.digest(docs).collect()}
    assert rows[1].n_turns == 20_000 and rows[2].loss_chars == 1_300_000
    assert rows[1].loss_chars == 4 * 6667 + sum(len(f"text {i}") for i in range(20_000) if i % 3)
    assert time.time() - began < 60


def test_windows_run_no_python(spark):
    docs = spark.createDataFrame([(1, 0, "user", "a", "x")], SCHEMA)
    plan = chat_format.digest(docs)
    assert "Python" not in plan._jdf.queryExecution().toString()
    assert chat_format.digest(docs.limit(0)).count() == 0


def test_escape_is_reversible(spark):
    r = random.Random(0)
    texts = ["".join(r.choice("\\<[bli/s>INST]") for _ in range(r.randrange(30))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect()
    assert all(x.t == x.u and "<" not in x.e and "[" not in x.e for x in got)


def exact(ids, x, k, step=20):
    """Of rows (ids may repeat), the nearest of every query; of one id's different vectors the least asks."""
    out = {}
    asks = {}
    for n, i in enumerate(ids):
        if i % step == 0 and (i not in asks or x[n].tolist() < x[asks[i]].tolist()):
            asks[i] = n
    for i, n in asks.items():
        score = np.zeros(len(x))
        for d in range(x.shape[1]):
            score += x[n, d] * x[:, d]
        order = sorted((-s, j) for m, (s, j) in enumerate(zip(score, ids, strict=True)) if m != n)[:k]
        out[i] = [(j, -s) for s, j in order]
    return out


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_search_reaches_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = table.orderBy("vec_id").toPandas()
    want = exact(data.vec_id.tolist(), np.stack(data.embedding).astype(np.float64), 20)
    got = ranked(vector_tree.search(table).collect())
    again = ranked(vector_tree.search(table.repartition(5)).collect())
    assert set(got) == set(want) and got == again
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, own in got.items():
        assert own == sorted(own, key=lambda x: (-x[1], x[0])) and len(own) == 20


def test_copies_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_tree, "BLOCK_ROWS", (8, 16))
    monkeypatch.setattr(vector_tree, "TILE_ROWS", 2)
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 4)).astype(np.float32)
    rows = [(i, [float(v) for v in (x[0] if i < 60 else x[i % 40])]) for i in range(200)]
    rows += [(20, [0.5, 0.25, 2.0, 1.0]), (20, [float(v) for v in x[3]]), (20, [float(v) for v in x[20]]), (41, [1.0] * 4), (41, [1.0] * 4)]
    whole = list(rows)
    rows += [(1000, None), (1020, [0.0] * 4), (1040, [1.0, None, 0.0, 0.0]), (1060, [float("nan"), 1.0, 1.0, 1.0]), (1080, [float("inf"), 0.0, 0.0, 0.0]), (1100, [1.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    want = exact([i for i, _ in whole], np.array([v for _, v in whole]), 20)
    assert ranked(vector_tree.search(table, aim=1.0).collect()) == want
    assert vector_tree.search(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert ranked(vector_tree.search(few).collect()) == {0: [(1, 4.0), (20, 3.0)], 20: [(0, 3.0), (1, 3.0)]}


def test_blocks_follow_the_leaves():
    counts = {0: 3, 1: 4, 2: 30, 3: 1, 4: 9, 6: 2, 7: 10, 8: 11}
    first, n = vector_tree.blocks_of(counts, 9, 10)
    assert (first, n) == ([0, 0, 1, 4, 4, 4, 5, 6, 7], [1, 1, 3, 1, 1, 1, 1, 1, 2])
    assert vector_tree.blocks_of({}, 1, 10) == ([0], [1])


def test_queries_go_to_the_leaves_they_visit(spark):
    """Twice the vectors, with the same visits: a query goes to as many blocks, no more."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16))
    sent = {}
    for n in (8000, 16_000):
        x = centres[r.integers(0, 40, n)] + 0.1 * r.normal(size=(n, 16))
        table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        index = vector_tree.Index(vector_tree._usable(table), 20)
        queries = table.filter("vec_id < 400").selectExpr("vec_id as query_id", "embedding")
        blocks = len({b for f, m in zip(index.first, index.n_blocks, strict=True) for b in range(f, f + m)})
        sent[n] = index.asked(queries, 3).count()
        assert 400 <= sent[n] <= 3 * 400 and blocks > 6
    assert sent[16_000] <= 1.2 * sent[8000]
