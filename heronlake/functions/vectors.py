"""Vector arithmetic on array columns, in double precision and in the order of the dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def inverse_distance(distance: Column) -> Column:
    return F.when(distance == 0, F.lit(1e9)).otherwise(1 / distance)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; the count is at least 1e-9."""
    count = F.greatest(_sum(F.transform(mask, lambda m: m.cast("double"))), F.lit(1e-9))
    kept = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m.cast("double")))
    total = F.aggregate(
        F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), kept[0], lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y)
    )
    return F.transform(total, lambda x: x / count)
