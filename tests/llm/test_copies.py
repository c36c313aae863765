"""Exact dedup and the n-gram join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.llm import exact_dedup, ngram_join, shingles, sides
from heronlake.llm import components as component_module
from heronlake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in texts], SCHEMA).repartition(5)


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 40, 200]))] for _ in range(25)]
    out = []
    for b in base:
        for _ in range(r.choice([1, 1, 4, 12])):
            c = list(b)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                c[r.randrange(len(c))] = r.choice(words)
            out.append(r.choice([" ", "\n", "  ", "\t\x0b"]).join(c))
    shared = " ".join(words[:60])
    out += [shared + " " + " ".join(r.choice(words) for _ in range(30)) for _ in range(20)]
    out += [None, "", " \n", "A b", "a B", "É a", "x\u00a0y", "  lead", "lead  ", "long " * 4000]
    return list(enumerate(out))


def grams(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, percent):
    sets = {i: grams(t, k) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_shingles_equal_words():
    texts = [t for _, t in corpus()]
    found = shingles.shingle_sets([(t or "").encode() for t in texts], 4)
    assert [len(s) for s in found] == [len(grams(t, 4)) for t in texts]
    for i in range(0, len(texts), 3):
        for j in range(0, len(texts), 7):
            assert len(set(found[i]) & set(found[j])) == len(grams(texts[i], 4) & grams(texts[j], 4))


def test_shingles_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000)).encode()
    whole = shingles.shingle_sets([text], 5)[0]
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    assert (shingles.shingle_sets([text], 5)[0] == whole).all()
    assert len(shingles.shingle_sets([b"x" * 5000 + b" y z"], 2)[0]) == 2


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components_equal_brute_force(spark, k, percent):
    texts = corpus()
    rows = ngram_join.link_components(frame(spark, texts), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, k, percent)


def test_many_near_copies_are_one_component(spark):
    r = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(150):
        c = list(base)
        for _ in range(2):
            c[r.randrange(120)] = f"u{r.randrange(10**6)}"
        texts.append((i, " ".join(c)))
    rows = ngram_join.link_components(frame(spark, texts), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: x[1] for i, x in brute_components(texts, 4, 85).items()}


@pytest.mark.parametrize("block", [4, 256])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    texts = corpus()
    for i in range(60):
        c = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            c[r.randrange(80)] = f"u{r.randrange(10**6)}"
        texts.append((1000 + i, " ".join(c)))
    sets = {i: grams(t, 4) for i, t in texts}
    linked = lambda a, b: a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    want = {a: (*x, sum(bool(linked(a, b)) for b in sets)) for a, x in brute_components(texts, 4, 85).items()}
    rows = ngram_join.link_counts(frame(spark, texts), 4, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in rows} == want
    group = [n for i, (_, c, n) in want.items() if c == 1000]
    assert len(group) > 30 and sum(group) < len(group) * (len(group) - 1)  # a large component, but not all of its pairs


def test_hot_shingles_do_not_change_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 1)
    monkeypatch.setattr(sides, "BROADCAST_BYTES", 0)
    real = ngram_join._heavy_shingles
    texts = corpus(8)
    sets = shingles.shingle_sets([(t or "").encode() for _, t in texts], 4)
    token, n = np.unique(np.concatenate(sets), return_counts=True)
    often = token[n >= 3]
    order = np.random.default_rng(1).permutation(len(often))
    monkeypatch.setattr(ngram_join, "_heavy_shingles", lambda docs, k: (often, order))
    assert len(often) > 50 and len(real(frame(spark, texts), 4)[0]) < len(often)
    rows = ngram_join.link_components(frame(spark, texts), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, 4, 85)


def test_frequent_shingles_come_last_and_rare_ones_first():
    r = np.random.default_rng(3)
    heavy = np.sort(r.choice(10**9, 50, replace=False))
    rank = r.permutation(50)
    for n in (1, 3, 5, 12, 40, 400):
        s = np.unique(np.concatenate([r.choice(10**9, n), r.choice(heavy, n % 7)]))
        for percent in (85, 80, 50):
            need = ngram_join._prefix(len(s), percent)
            sizes, counted, rest = ngram_join._ahead(s, need, heavy, rank)
            cold = set(s.tolist()) - set(heavy.tolist())
            assert sum(sizes) == len(counted) and set(counted.tolist()) <= cold
            assert len(counted) + len(rest) >= need or len(counted) + len(rest) == len(s)
            assert not len(rest) or set(counted.tolist()) == cold  # very frequent ones only when nothing else is left
            places = [rank[np.searchsorted(heavy, x)] for x in rest]
            assert places == sorted(places) and set(rest.tolist()) <= set(heavy.tolist())


def test_frequent_shingles_are_found_in_all_documents(spark):
    texts = [(i, f"own{i} a{i} b{i} c{i} " + "the same passage is here again " * (i % 2)) for i in range(200)] + [(1000 + i, "copies of one text are one set") for i in range(50)]
    token, rank = ngram_join._heavy_shingles(frame(spark, texts).coalesce(1), 4)
    same = shingles.shingle_sets([b"the same passage is here again"], 4)[0]
    assert set(same.tolist()) <= set(token.tolist()) and sorted(rank) == list(range(len(token)))
    one = shingles.shingle_sets([b"copies of one text are one set"], 4)[0]
    assert not set(one.tolist()) & set(token.tolist())


def test_words_of_a_whole_block_hash_alike(monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 64)
    for size in (63, 64, 65, 128, 200):
        word = b"w" * size
        for before in range(0, 70, 3):
            text = b"x" * before + b" " * (before > 0) + word + b" y"
            have = shingles.shingle_sets([text], 1)[0]
            assert shingles.shingle_sets([word], 1)[0][0] in have, (size, before)


def test_columns_that_clash(spark):
    texts = corpus()
    docs = frame(spark, texts)
    names = ["gone_id", "__d", "__s", "__sha", "__n", "gone_key", "digest", "n", "a.b", "row"]
    for c in names:
        docs = docs.withColumn(c, docs["doc_id"])
    for drop in (ngram_join.drop_near_copies, exact_dedup.drop_copies):
        kept = drop(docs)
        assert kept.columns == docs.columns
        assert all(r[c] == r.doc_id for r in kept.collect() for c in names)
    odd = docs.unionByName(docs.filter("doc_id < 30").withColumn("doc_id", docs["doc_id"] * 0))
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == docs.columns and kept.select("__sha").distinct().count() > 1
    assert ngram_join.link_components(docs).columns == ["doc_id", "n_shingles", "component_id"]


def test_classes_that_share_half_a_name_keep_their_own_prefixes(spark):
    _, sets, classes, _ = ngram_join._joined(frame(spark, corpus()), 4, 85)
    whole = sorted(ngram_join._prefixes(sets, classes, 85).collect())
    alike = [df.drop("name").withColumn("k1", F.pmod("k1", F.lit(3))) for df in (sets, classes)]
    assert alike[1].select("k1").distinct().count() == 3
    named = ngram_join._short_names(*alike)
    assert named[1].select("name").distinct().count() == classes.count()
    assert whole and sorted(ngram_join._prefixes(*named, 85).collect()) == whole


def test_join_of_odd_tables(spark):
    empty = frame(spark, []).limit(0)
    assert ngram_join.link_components(empty).count() == 0
    assert exact_dedup.find_copies(empty).count() == 0
    odd = frame(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (8, "")])
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.link_components(odd).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (7, 7), (8, 8)], key=str)


def test_near_copies_are_dropped_whole(spark):
    texts = corpus()
    docs = frame(spark, texts)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute_components(texts, 5, 80).items() if i == c)


def test_a_clean_text_outlives_a_near_copy_of_its_doc_id(spark):
    near = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, near), (5, near + " end"), (5, "clean and other words that nobody else uses"), (6, near + " stop"), (7, None), (7, near)])
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.drop_near_copies(docs).collect()), key=str)
    assert kept == [(1, near), (5, "clean and other words that nobody else uses"), (7, None)]


@pytest.mark.parametrize("small", [0, 500_000])
def test_components_of_a_path_and_a_star(spark, monkeypatch, small):
    monkeypatch.setattr(component_module, "SMALL", small)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digest_size", [16, 1])
def test_exact_copies_equal_brute_force(spark, digest_size):
    r = random.Random(5)
    long = " ".join(str(r.random()) for _ in range(3000))
    texts = corpus() + [(900, long), (901, long.replace(" ", "\n\n")), (902, long + "!"), (903, "!" + long), (904, " ")]
    groups = {}
    for i, t in texts:
        groups.setdefault(normal(t), []).append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    rows = exact_dedup.find_copies(frame(spark, texts), digest_size).collect()
    assert {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in rows} == want


def test_chunks_join_up_and_follow_content():
    r = random.Random(2)
    data = bytes(r.randrange(97, 123) for _ in range(200_000))
    parts = exact_dedup.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= exact_dedup.MOST
    moved = exact_dedup.chunks(b"some words in front " + data)
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    assert exact_dedup.chunks(b"") == [] and b"".join(exact_dedup.chunks(b"a" * 50_000)) == b"a" * 50_000


def test_rows_without_own_id(spark):
    docs = frame(spark, [(None, "a"), (None, "a"), (3, "b"), (3, "b"), (3, "c"), (4, "c"), (5, None), (6, "")])
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs).collect()), key=str)
    assert kept == sorted([(None, "a"), (3, "b"), (3, "c"), (5, None)], key=str)
    assert sum(r.kept for r in exact_dedup.find_copies(docs).collect()) == 4


def test_copies_are_dropped_with_all_columns(spark):
    docs = frame(spark, corpus())
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({normal(t) for _, t in corpus()})
