"""Sides of joins: names that clash with no column of the input, and broadcasts behind a check of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows are broadcast up to so many bytes; beyond, the same join is shuffled.
BROADCAST_BYTES = 32 << 20


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores in front until no column of `df` has them (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def own(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def _width(value: Column, kind: T.DataType) -> Column | int:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        each = kind.elementType
        fixed = 8 * (1 + len(each.fields)) if isinstance(each, T.StructType) else 8
        if isinstance(each, T.StringType | T.BinaryType):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + 8 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        return F.coalesce(fixed * F.size(value), F.lit(0))
    return 0


def bounded(rows: DataFrame, most: int | None = None) -> DataFrame:
    """`rows`, marked for broadcast if they hold at most `most` bytes: 8 a column and 16 a row, and the lengths of strings and arrays.

    `rows` should be cheap to read (a checkpoint), since they are read to be measured.
    """
    most = BROADCAST_BYTES if most is None else most
    fixed = 16 + 8 * len(rows.columns)
    if rows.limit(most // fixed + 1).count() > most // fixed:
        return rows
    widths = [w for w in (_width(col(f.name), f.dataType) for f in rows.schema.fields) if not isinstance(w, int)]
    if widths:
        total = widths[0].cast("long")
        for w in widths[1:]:
            total = total + w
        if (rows.agg(F.sum(total + fixed)).first()[0] or 0) > most:
            return rows
    return F.broadcast(rows)
