"""Word shingles of whole texts as 64-bit hashes, computed in vectorised passes over bytes."""

from __future__ import annotations

import re

import numpy as np

#: Bytes hashed at once; bounds a worker's memory to about thirty times this.
BLOCK = 1 << 18

_SPACES = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[list(_SPACES)] = False
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(BLOCK + 1, np.uint64(base & (2**64 - 1)))
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of at most BLOCK bytes."""
    power, inverse = _tables()
    data = np.frombuffer(text, np.uint8)
    edges = np.diff(_WORD_BYTE[data].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[_LOWER[data]] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _long_text_words(text: bytes) -> np.ndarray:
    """Word hashes of a text of BLOCK bytes or more, block by block, cut between words.

    A word of BLOCK bytes or more is hashed piece by piece wherever it stands.
    """
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        if end - at == BLOCK:
            cut = max(text.rfind(bytes([s]), at, end) for s in _SPACES)
            if cut < 0:  # one word fills the block: hash it piece by piece
                gap = re.compile(rb"[ \t\n\x0b\x0c\r]").search(text, end)
                stop = gap.start() if gap else len(text)
                pieces = [_hash_words(text[a : min(stop, a + BLOCK)])[0] for a in range(at, stop, BLOCK)]
                word = np.uint64(stop - at)
                for p in np.concatenate(pieces):
                    word = mix(np.array([word + p]))[0]
                out.append(np.array([word], np.uint64))
                at = stop
                continue
            end = cut + 1
        out.append(_hash_words(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        h = mix(h + words[j : j + n] + np.uint64(j + 1)) if n > 0 else h
    return h


def _whole(words: np.ndarray, k: int) -> np.ndarray:
    """The one hash of a sequence of fewer than k words."""
    h = np.array([0xD6E8FEB86659FD93 + len(words)], np.uint64)
    for w in words:
        h = mix(h ^ w)
    return h


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes (int64).

    Words are runs of bytes other than \\x20 and \\x09-\\x0D with A-Z lower-cased. With
    fewer than k words the whole sequence is one shingle; without words the set is empty.
    """
    out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
    with np.errstate(over="ignore"):
        at = 0
        while at < len(texts):
            if len(texts[at]) >= BLOCK:
                groups = [(at, _long_text_words(texts[at]))]
                stop = at + 1
            else:
                stop, size = at, 0
                while stop < len(texts) and size + len(texts[stop]) + 1 <= BLOCK:
                    size += len(texts[stop]) + 1
                    stop += 1
                stop = max(stop, at + 1)
                block = texts[at:stop]
                if len(block) == 1:
                    groups = [(at, _hash_words(block[0])[0])]
                else:
                    words, starts = _hash_words(b" ".join(block))
                    begins = np.cumsum([0] + [len(t) + 1 for t in block])
                    bounds = np.searchsorted(starts, begins)
                    groups = [(at + i, words[bounds[i] : bounds[i + 1]]) for i in range(len(block))]
            for i, words in groups:
                if len(words) == 0:
                    out[i] = np.zeros(0, np.int64)
                    continue
                h = (_grams(words, k) if len(words) >= k else _whole(words, k)).view(np.int64)
                h.sort()
                out[i] = h[np.concatenate(([True], h[1:] != h[:-1]))]
            at = stop
    return out
