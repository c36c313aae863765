"""Packing and token counts against brute force."""

import itertools
import json
import random
import sys
import zlib

import numpy as np
import pytest

from heronlake.llm import packing, token_counts, worker


@pytest.fixture(scope="module")
def path():
    return packing.vocabulary_path()


TEXTS = [
    None, "", " ", "Hello, World's best 2024 prices!!", "word " * 5000, "Çà et là — naïve café", "a<|endoftext|>b <|startoftext|>", "x\x01y \x01",
    "日本語 テキスト", "tab\tnew\nline\u00a0nbsp\u2003em", "don't WE'LL", "e\u0301 \u0301x", "ABC" * 900, "'s 's", "\x1c\x1d sep", "ﬁ İstanbul ΣΑΣ ß",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, start string").repartition(3)


def test_ids_equal_the_tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = [x or "" for x in TEXTS]
    found = packing.WordEncoder(path).encode([x.encode() for x in texts])
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert found == want


def test_ids_of_the_corpus_equal_the_tokenizer(spark, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encoder = packing.WordEncoder(path)
    assert encoder.latin
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.encode([x.encode() for x in texts]) == want
    odd = ["".join(map(chr, range(a, a + 40))) for a in range(32, 0x250, 7)] + ["ŉ ǆ İ ı ſ ĳ. Ŀ, ª º µ", "A." * 50]
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(odd, add_special_tokens=False)]
    assert encoder.encode([x.encode() for x in odd]) == want
    letters = [chr(c) * 2 + "x" for c in range(0x41, 0x180) if chr(c).isalpha()]
    assert encoder.encode([x.encode() for x in letters]) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(letters, add_special_tokens=False)]


def test_a_word_is_looked_up_once_whatever_touches_it(path):
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    words = ["".join(p) for p in itertools.product("bcd", "aeiou", "lmn", "aeo")]
    texts = [" ".join(a + w + b for w in words) for a in ("", "(", "[") for b in ("", ",", ".", "!?", "***", ":)")] + [" ".join(words).upper(), " ".join(words).title()]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert [encoder.encode([x.encode()])[0] for x in texts] == want
    assert len(words) <= len(encoder.known.young) <= len(words) + 20
    # next to signs that end no piece, that compose, or that belong to an added token
    odd = ["a<|endoftext|>b.<|endoftext|>.", "x<|ENDOFTEXT|>. <|StartOfText|>", "H\u0331 H\u0591\u0331. h\u0331 a=\u0338b", "I\u0307. \u0130. \u0130a.", "it.'s 's.'S don'.t", "a\u00d7. a\u00f7. \u00df.x 1.5.a", "\u2026. \u201ca.\u201d", ".\u0301a E.\u0301"]
    for texts in (odd, [x * 3 for x in odd], *([x] for x in odd)):
        assert encoder.encode([x.encode() for x in texts]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def check_packing(rows, ids, capacity, segments):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= capacity and len(own) <= segments
    return sequences


def test_every_id_is_packed_once(spark, path):
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = TEXTS + [" ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randrange(1, 900))) for _ in range(150)]
    t = Tokenizer.from_file(path)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    rows = packing.pack(frame(spark, texts)).collect()
    check_unpadded(check_packing(rows, ids, 2048, 2048))


def check_unpadded(sequences):
    sizes = [sum(r.length for r in own) for own in sequences.values()]
    assert all(n & (n - 1) == 0 for n in sizes)
    return sizes


def test_short_texts_are_not_padded(spark):
    rows = packing.pack(frame(spark, ["a b c d", None, ""] * 1500)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    sizes = check_unpadded(by)
    assert sum(sizes) == 1500 * 7 and sizes.count(2048) >= 1500 * 7 // 2048 - 3


def test_odd_ids_and_clashing_columns(spark, path):
    rows = [(None, "one two", "x"), (None, None, "x"), (3, "same", "x"), (3, "same", "x"), (3, "other text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").selectExpr("*", "1 as ask", "'y' as offset", "2 as prompt").coalesce(1)
    got = packing.pack(docs).collect()
    ids = packing.WordEncoder(path).encode([(t or "").encode() for _, t, _ in rows])
    whole = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        whole.setdefault(r.doc_id, []).append(r.length)
    assert sum(whole[None]) == sum(len(x) // 4 + 1 for x in ids[:2]) and sum(whole[3]) == sum(len(x) // 4 + 1 for x in ids[2:])
    counted = token_counts.count_tokens(docs.withColumn("n_words", docs["text"])).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_tokens) for r in counted) == sorted((d is None, len((t or "").split()), len(x) // 4) for (d, t, _), x in zip(rows, ids, strict=True))


def test_asks_bear_no_loss(spark, path):
    encoder = packing.WordEncoder(path)
    pairs = [(i, "what is this " * (i % 9), "an answer " * (i % 5 + 1)) for i in range(200)] + [(200, None, None), (201, "q " * 90, "a " * 9000)]
    docs = spark.createDataFrame(pairs, "doc_id long, ask string, text string").repartition(3)
    rows = packing.pack(docs, max_segments=24, max_loss=256, capacity=512, ask_col="ask").collect()
    ids = {d: np.frombuffer(encoder.encode([(q or "").encode()])[0] + encoder.encode([(a or "").encode()])[0], "<u4").tolist() + [1] for d, q, a in pairs}
    asked = {d: len(encoder.encode([(q or "").encode()])[0]) // 4 for d, q, a in pairs}
    sequences = check_packing(rows, ids, 512, 24)
    assert all(sum(r.loss_tokens for r in own) <= 256 for own in sequences.values())
    for r in rows:
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, asked[r.doc_id]))
    # each limit closes some sequence
    for of, most in (("length", 512), ("loss_tokens", 256)):
        assert any(sum(r[of] for r in own) == most for own in sequences.values())
    assert any(len(own) == 24 for own in sequences.values())


def test_memory_is_bounded_in_bytes(path):
    r = random.Random(1)
    unspaced = "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(3000))
    texts = [unspaced.encode()] + [" ".join("".join(r.choice("abcdefgh") for _ in range(40)) for _ in range(400)).encode() for _ in range(40)]
    for found in (packing.WordEncoder(path, 1 << 20), token_counts.Counter(path, 1 << 20)):
        run = found.encode if hasattr(found, "encode") else found.texts
        want = [run([t])[0] for t in texts]
        assert run(texts) == want
        held = [x for d in (found.known.young, found.known.old) for x in d.items()]
        assert held and max(len(k) for k, _ in held) <= worker.LONGEST
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) + 40 for k, v in held) <= 1 << 20


def test_long_texts_are_read_in_parts(path, monkeypatch):
    texts = [x.encode() for x in TEXTS if x] + [b"word, word " * 300, b"x" * 900 + b" y"]
    encoder, counter = packing.WordEncoder(path), token_counts.Counter(path)
    ids, counts = encoder.encode(texts), counter.texts(texts)
    monkeypatch.setattr(worker, "SIZE", 100)
    assert all(b"".join(worker.parts(t, 100)) == t for t in texts)
    assert [encoder.encode([t])[0] for t in texts] == ids and counter.texts(texts) == counts


def test_a_worker_keeps_one_operators_memory():
    made = []
    get = lambda owner: worker.owned(owner, (1,), lambda: made.append(owner) or len(made))
    assert [get("a"), get("a"), get("b"), get("a")] == [1, 1, 2, 3]
    worker.forget("a")
    assert get("a") == 3
    worker.forget("c")
    assert get("a") == 4


def test_all_three_limits_hold(spark):
    docs = frame(spark, ["one two three four five six"] * 50 + ["a"] * 50).withColumnRenamed("start", "x")
    from pyspark.sql import functions as F

    docs = docs.withColumn("prompt", F.when(F.col("doc_id") % 3 == 0, 4))
    rows = packing.pack(docs, capacity=32, max_segments=3, max_loss=10, prompt_col="prompt").collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.length for r in x) <= 32 and len(x) <= 3 and sum(r.loss_tokens for r in x) <= 10 for x in by.values())
    assert sum(r.length for r in rows) == 50 * 7 + 50 * 2


def test_empty_table(spark):
    empty = frame(spark, [""]).limit(0)
    assert packing.pack(empty).count() == 0 and token_counts.count_tokens(empty).count() == 0


def greedy(symbols, tokens):
    n, at = 0, 0
    while at < len(symbols):
        end = next((e for e in range(len(symbols), at, -1) if tuple(symbols[at:e]) in tokens), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_equals_greedy_on_random_vocabularies():
    r = random.Random(9)
    for _ in range(60):
        tokens = {tuple(r.randrange(3) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 14))}
        if r.random() < 0.7:
            tokens |= {(0,), (1,), (2,)}
        a = token_counts.Automaton(tokens)
        for _ in range(60):
            w = [r.randrange(3) for _ in range(r.randrange(1, 14))]
            assert a.count(w) == greedy(w, tokens), (tokens, w)


def test_counts_equal_greedy_on_the_vocabulary(spark, path):
    tokens = token_counts.vocabulary(path)
    assert len(tokens) == len(json.load(open(path))["model"]["vocab"])
    c = token_counts.Counter(path)
    for text in TEXTS:
        words = [w for p in (text or "").encode().split() for w in token_counts._WORDS.findall("".join(x.lower() for x in token_counts.unicodedata.normalize("NFC", p.decode())))]
        want = len(words), sum(greedy((*w.encode(), token_counts.END), tokens) for w in words)
        assert c.texts([(text or "").encode()]) == [want]
    rows = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(frame(spark, TEXTS)).collect()}
    assert rows == dict(enumerate(c.texts([(t or "").encode() for t in TEXTS])))
