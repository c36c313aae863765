"""Removal of lines that are boilerplate of their site.

Per host, the share of its pages that hold a line is the number of pages with the line
over the host's page total. Lines over `ratio` that are on at least `least_pages` pages of
the host are dropped from its pages. Lines are compared without surrounding spaces, by
64-bit hash and length; blank lines stay. A page counts a line once, and counts are summed
before they are shuffled, so neither a hot host nor a hot line gathers in one task. A host
has at most its mean number of lines per page / ratio such lines.

Defined cases: null text counts as a page without lines and stays null; null hosts are one
host; repeated rows are pages of their own. Texts of any length are read whole. An empty
table gives an empty result. Columns named n_lines and n_dropped are replaced by the result's;
all others are kept, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.sides import bounded, col, free_names
from heronlake.session import cut_lineage


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    body = F.trim(line)
    return F.struct(F.xxhash64(body).alias("h"), F.length(body).alias("n"))


def boilerplate(docs: DataFrame, host: str, ratio: float, least_pages: int) -> DataFrame:
    """(host, lines): each host's list of line keys over the ratio."""
    pages = docs.select(col(host).alias("host"), F.col("text").cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "of")
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("with_line"))
    counts = counts.filter(F.col("with_line") >= least_pages)
    over = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("with_line") > ratio * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def strip_boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.05, least_pages: int = 3) -> DataFrame:
    """The input's columns with the lines dropped from `text`, and n_lines and n_dropped."""
    of, drop = free_names(docs, "boilerplate_of", "boilerplate")
    lists = cut_lineage(boilerplate(docs, host, ratio, least_pages)).toDF(of, drop)
    rows = docs.join(bounded(lists), col(host).eqNullSafe(F.col(of)), "left")
    before = _lines(F.col("text").cast("string"))
    after = F.filter(before, lambda x: ~F.array_contains(F.col(drop), _key(x)))
    kept = F.when(F.col(drop).isNull(), before).otherwise(after)
    n, left = (F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)) for x in (before, kept))
    text = F.when(n == left, F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    return rows.select(
        *[text.alias(c) if c == "text" else col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")],
        n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_dropped"),
    )
