"""Greedy longest-match token counts by a linear automaton.

The vocabulary becomes a trie over bytes plus an end-of-word mark. Each node has a failure
link and the number of tokens that are popped on the way there, so one pass over a word
gives the number of pieces that greedy longest-match-first splitting would make, without
making them. Each step either reads a symbol or pops tokens, so a word takes linear time.
Counts of the pieces between white space are remembered up to a bound in bytes.

Words are found as the vocabulary's own splitter finds them: lower-cased runs of letters,
single digits, runs of other symbols, and the English contractions.

Defined cases: null and empty texts have no words and no tokens; null doc_ids are carried
and repeated rows repeat. A word with a symbol that no token begins with counts as one
unknown token. Texts of any length are read whole, in parts of about 1 MB cut at white space
(a longer piece without white space is one part). An empty table gives no rows. Columns other
than doc_id and text are ignored, whatever their names are.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm import worker

END = 256
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def vocabulary(path: str) -> set[tuple[int, ...]]:
    """Tokens as symbol sequences: bytes, and END where a token ends a word."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, mark = byte_symbols(), spec["model"].get("end_of_word_suffix") or ""
    special = {t["content"] for t in spec.get("added_tokens", [])}
    out = set()
    for token in spec["model"]["vocab"]:
        if token in special:
            continue
        ends = bool(mark) and token.endswith(mark)
        body = token[: -len(mark)] if ends else token
        if all(c in symbols for c in body):
            out.add(tuple(symbols[c] for c in body) + (END,) * ends)
    return out - {()}


class Automaton:
    """Trie with failure links and popped-token counts. `count` takes a word's symbols."""

    def __init__(self, tokens: set[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for token in sorted(tokens):
            node = 0
            for c in token:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][c]
            final[node] = True
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if final[v]:
                        self.fail[v], self.pops[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.next[z]:
                        n, z = n + self.pops[z], self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z][c], n
            level = below

    def count(self, symbols) -> int:
        """The number of greedy pieces; 1 if the word can't be split."""
        nodes, fail, pops, node, n = self.next, self.fail, self.pops, 0, 0
        for c in symbols:
            while c not in nodes[node]:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nodes[node][c]
        while node:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


class Counter:
    """(words, tokens) of texts. Counts of the pieces between white space are remembered, bounded in bytes."""

    def __init__(self, path: str, memory: int = worker.MEMORY):
        tokens = vocabulary(path)
        self.end = (END,) if any(t[-1] == END for t in tokens) else ()
        self.automaton = Automaton(tokens)
        self.known = worker.Remembered(memory, lambda values: 32 * len(values))

    def piece(self, piece: bytes) -> int:
        """Words << 32 | tokens of a piece."""
        text = piece.decode()
        if not piece.isascii():
            text = unicodedata.normalize("NFC", text)
        # letter by letter, as a final sigma is no case of its own here
        text = text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)
        words = [text] if text.isalpha() and max(text) < "\u0250" else _WORDS.findall(text)
        return len(words) << 32 | sum(self.automaton.count((*w.encode(), *self.end)) for w in words)

    def _learn(self, pieces: list[bytes]) -> dict[bytes, int]:
        return {p: self.piece(p) for p in pieces}

    def _texts(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        get = self.known.lookup(worker.words(split), self._learn).__getitem__
        return [sum(map(get, w)) for w in split]

    def texts(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        if sum(map(len, texts)) <= 2 * worker.SIZE:
            sums = self._texts(texts)
        else:
            sums = [sum(self._texts([part])[0] for part in worker.parts(t)) for t in texts]
        return [(x >> 32, x & 0xFFFFFFFF) for x in sums]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker.owned("token_counts", (path,), lambda: Counter(path))
        for batch in worker.slices(batches):
            found = counter.texts(worker.texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )
        worker.give_back()

    return run


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens. `path`: a tokenizers file with a vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(path), "doc_id long, n_words long, n_tokens long")
