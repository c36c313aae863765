"""Memory of Python workers: Arrow batches in small slices, and caches bounded by bytes.

A worker process is used again by later tasks, also of other operators. So what an operator
remembers between its tasks is bounded in bytes, and is dropped as soon as the worker runs a
task of another operator.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text that are worked on at once.
ROWS, SIZE = 500, 1 << 20
#: Bytes that one cache may hold, in two generations, and bytes of an entry beside its value and its key's signs.
MEMORY, ENTRY = 48 << 20, 110
#: Longer keys are not remembered.
LONGEST = 64

_state: dict = {}


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = SIZE, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and about `size` bytes of `column`; a longer text is a part of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Free memory of Arrow and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def owned(owner: str, key: tuple, make: Callable):
    """What `make` gives, kept for the worker's next tasks of the same owner and key alone."""
    if _state.get("of") != (owner, key):
        forget()
        _state.update(of=(owner, key), value=make())
    return _state["value"]


def forget(owner: str | None = None) -> None:
    """Drop what another operator keeps (whatever is kept, without an owner)."""
    if _state and (owner is None or _state["of"][0] != owner):
        _state.clear()
        give_back()


class Remembered:
    """A mapping of short byte strings, bounded in bytes.

    `weigh` gives the bytes of some values. New entries go to the young generation. When that is full it becomes the old one, and
    the old one's entries are gone, but for those that were asked for meanwhile.
    """

    def __init__(self, memory: int = MEMORY, weigh: Callable = lambda values: sum(map(len, values)) + 33 * len(values)):
        self.half, self.held, self.weigh = memory // 2, 0, weigh
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def _add(self, entries: dict) -> None:
        cost = sum(map(len, entries)) + self.weigh(entries.values()) + ENTRY * len(entries)
        if self.held + cost > self.half:
            self.young, self.old, self.held = {}, self.young, 0
        if cost <= self.half:
            self.young.update(entries)
            self.held += cost
        else:
            self.young = {}
            self.held = 0

    def lookup(self, keys: set[bytes], learn: Callable[[list[bytes]], dict]) -> dict:
        """Values of all keys; `learn` gives those of the keys that aren't known."""
        young, old = self.young, self.old
        new = keys.difference(young)
        if not new:
            return young
        again = {k: old[k] for k in new.intersection(old)}
        fresh = learn(list(new.difference(again)))
        whole = max(map(len, fresh), default=0) <= LONGEST
        added = again | (fresh if whole else {k: v for k, v in fresh.items() if len(k) <= LONGEST})
        self._add(added)
        if whole and self.young is young:
            return young
        return {k: young[k] for k in keys.intersection(young)} | fresh | again


def parts(text: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text cut at ASCII white space into parts of about `size` bytes; a longer piece without white space is a part."""
    at, size = 0, size or SIZE
    while at < len(text):
        end = at + size
        if end >= len(text):
            yield text[at:]
            return
        cut = max(text.rfind(s, at, end) for s in _SPACES)
        if cut < 0:
            cut = min((x for x in (text.find(s, end) for s in _SPACES) if x >= 0), default=len(text))
        yield text[at : cut + 1]
        at = cut + 1


_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def words(split: list[list[bytes]]) -> set[bytes]:
    return set(chain.from_iterable(split))
