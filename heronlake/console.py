"""A console over a saved index: reads lines `text|mode` and prints the hits of each.

    python -m heronlake.console INDEX [DOCUMENTS]
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.functions.text import result_line
from heronlake.operators.bm25 import search_line
from heronlake.operators.index import Index


def answer(spark: SparkSession, index: Index, line: str, k: int = 20, docs: DataFrame | None = None) -> list[str]:
    """The result lines of one query line, best first."""
    found = search_line(spark, index, line, k, docs)
    content = F.col("content") if docs is not None else None
    return [r.line for r in found.select("rank", result_line(F.col("doc_id"), F.col("score"), content).alias("line")).orderBy("rank").collect()]


def loop(spark: SparkSession, index: Index, lines: Iterable[str], out: TextIO, k: int = 20, docs: DataFrame | None = None) -> None:
    """Answer every line until they end or one says `exit`; a line that can't be read is told so."""
    for line in lines:
        if line.strip().lower() == "exit":
            return
        try:
            out.write("".join(f"{x}\n" for x in answer(spark, index, line, k, docs)) or "no match\n")
        except ValueError as e:
            out.write(f"{e}\n")


if __name__ == "__main__":
    from heronlake.session import build_session

    session = build_session("console", None if "--cluster" in sys.argv else "local[*]")
    paths = [a for a in sys.argv[1:] if not a.startswith("--")]
    texts = session.read.parquet(paths[1]) if len(paths) > 1 else None
    loop(session, Index.load(session, paths[0]), sys.stdin, sys.stdout, docs=texts)
