"""Arrays and maps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first(values: Column, k: int) -> Column:
    """The first k elements (all, if fewer)."""
    return F.slice(values, 1, k)


def lookup(keys: Column, values: Column, key: Column) -> Column:
    """The value at `key` of two parallel arrays; null if there is none. A join is better for many keys."""
    return F.try_element_at(F.map_from_arrays(keys, values), key)
