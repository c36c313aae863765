"""Numbers as bytes in groups of 7 bits, for whole Arrow arrays at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _lists(sizes: np.ndarray, values: pa.Array, valid: np.ndarray) -> pa.Array:
    """A list array of rows of these sizes; rows that are not valid (and have size 0) are null."""
    ends = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=None if valid.all() else pa.array(~valid))


def _flat(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, row of each, whether a row is valid): rows that are null or hold a null are left out."""
    sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values, own = rows.flatten(), np.repeat(np.arange(len(rows)), sizes)
    valid = rows.is_valid().to_numpy(zero_copy_only=False).copy()
    if values.null_count:
        valid[own[values.is_null().to_numpy(zero_copy_only=False)]] = False
        values = values.fill_null(0)
    numbers, kept = values.to_numpy(zero_copy_only=False).astype(np.int64), valid[own]
    return (numbers, own, valid) if kept.all() else (numbers[kept], own[kept], valid)


def encode(rows: pa.Array) -> pa.Array:
    numbers, own, valid = _flat(rows)
    sizes = np.ones(len(numbers), dtype=np.int64)
    for k in range(1, 9):
        sizes += numbers >= 1 << (7 * k)
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    coded = np.repeat(numbers, sizes) >> (7 * place) & 127
    coded[place < np.repeat(sizes, sizes) - 1] += 128
    return _lists(np.bincount(own, sizes, len(rows)).astype(np.int64), pa.array(coded.astype(np.int32)), valid)


def decode(rows: pa.Array) -> pa.Array:
    coded, own, valid = _flat(rows)
    if not len(coded):
        return _lists(np.zeros(len(rows), dtype=np.int64), pa.array([], pa.int64()), valid)
    last = coded < 128
    start = np.flatnonzero(np.r_[True, last[:-1] | (own[1:] != own[:-1])])
    place = np.arange(len(coded)) - np.repeat(start, np.diff(np.r_[start, len(coded)]))
    numbers = np.add.reduceat(coded % 128 << (7 * place), start)
    whole = last[np.r_[start[1:], len(coded)] - 1]  # a number without its last byte is dropped
    return _lists(np.bincount(own[start][whole], minlength=len(rows)), pa.array(numbers[whole]), valid)
