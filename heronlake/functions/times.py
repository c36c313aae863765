"""Time scalars of crawl logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed_seconds(start: Column, stop: Column) -> Column:
    """Seconds from start to stop, with fractions."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(stop) - micros(start)) / 1e6


def file_stamp(at: Column) -> Column:
    """A time as part of a file name: year to second, joined by dashes."""
    return F.date_format(at, "yyyy-MM-dd-HH-mm-ss")
