"""Tokens of documents counted in Python workers, by bytes: the rules are those of `functions.text.index_tokens`."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from heronlake.functions.text import INDEX_HIGH_BYTES

#: Postings of one batch that a task hands on.
OUT_ROWS = 1 << 17
_SEPARATING = set(b" \t\n\x0b\x0c\r") | {c for c in range(0x21, 0x7F) if not chr(c).isalnum()} | set(INDEX_HIGH_BYTES)
#: Separators become spaces, A-Z small letters.
_TABLE = bytes(0x20 if c in _SEPARATING else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def _parts(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _is_token(part: bytes) -> bool:
    return 0x30 <= part[0] < 0x7B


def _terms(parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The parts as strings of ISO-8859-1, and which are tokens."""
    data = b"".join(parts)
    if not data.isascii():
        parts = [p if p.isascii() else p.decode("latin-1").encode() for p in parts]
        data = b"".join(parts)
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum(np.fromiter(map(len, parts), np.int32, len(parts)), out=ends[1:])
    first = np.frombuffer(data, dtype=np.uint8)[ends[:-1]]
    return pa.StringArray.from_buffers(len(parts), pa.py_buffer(ends), pa.py_buffer(data)), (first >= 0x30) & (first < 0x7B)


def _batch(docs: list[tuple[object, int, Counter]], id_type: pa.DataType) -> pa.RecordBatch:
    parts, counts = [], []
    for _, _, found in docs:
        parts.extend(found)
        counts.extend(found.values())
    term, good = _terms(parts)
    own = np.repeat(np.arange(len(docs)), [len(found) for *_, found in docs])[good]
    words = np.bincount(own, minlength=len(docs)).astype(np.int32)
    at = pa.array(own)
    columns = {
        "doc_id": pa.array([i for i, *_ in docs], id_type).take(at), "data_length": pa.array([n for _, n, _ in docs], pa.int32()).take(at),
        "word_count": pa.array(words[own]), "term": term.filter(pa.array(good)), "tf": pa.array(np.array(counts, dtype=np.int32)[good]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, data_length, word_count, term, tf) of rows (doc_id, data_length, data); rows of one doc_id follow each other and count as one text."""
    docs, size, kind = [], 0, None
    for batch in batches:
        kind = batch["doc_id"].type
        for doc_id, length, data in zip(batch["doc_id"].to_pylist(), batch["data_length"].to_pylist(), batch["data"], strict=True):
            found = Counter(_parts(data.as_buffer().to_pybytes()))
            if docs and docs[-1][0] == doc_id:
                docs[-1][2].update(found)
                continue
            if size >= OUT_ROWS:
                yield _batch(docs, kind)
                docs, size = [], 0
            docs.append((doc_id, length, found))
            size += len(found)
    if docs:
        yield _batch(docs, kind)


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, data_length, word_count) of rows (doc_id, data_length, data)."""
    for batch in batches:
        words = [sum(map(_is_token, set(_parts(data.as_buffer().to_pybytes())))) for data in batch["data"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["data_length"], pa.array(words, pa.int32())], ["doc_id", "data_length", "word_count"])
