"""Tokenizers and text helpers as Column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores are ranked and kept with so many decimals, so that sums in any order rank alike; queries show fewer.
DIGITS = 9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The bytes that separate tokens, besides ASCII white space and punctuation.
INDEX_HIGH_BYTES = (
    0x80, 0x82, 0x83, 0x84, 0x85, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8F, 0x90, 0x91, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9D, 0xA0, 0xA2, 0xA3, 0xA4, 0xA5,
    0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xAB, 0xAC, 0xAE, 0xAF, 0xB0, 0xB1, 0xB2, 0xB3, 0xB4, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xBB, 0xBC, 0xBD, 0xBE, 0xBF,
    0xC2, 0xC3, 0xE2, 0xEF,
)
QUERY_HIGH_BYTES = (
    0x80, 0x9A, 0x9C, 0x9D, 0xB7, 0xBC, 0xC2, 0xE2, 0xEF,
)
# Fixed values end.


def _class(high: tuple[int, ...], underscore: bool = True) -> str:
    marks = r"\s\x0b!-/:-@\[-^`{-~" + ("_" if underscore else "")
    return "[" + marks + "".join(rf"\x{b:02X}" for b in high) + "]"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def _bytes(text: Column) -> Column:
    return F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")


def token_parts(text: Column) -> Column:
    """What stands between the separators of a document, in ASCII lower case; tokens are the parts that `is_token`."""
    return F.split(ascii_lower(_bytes(text)), _class(INDEX_HIGH_BYTES))


def is_token(part: Column) -> Column:
    """Whether a part begins with a letter or digit: no other sign between "0" and "z" is left in a part."""
    return (part >= "0") & (part < "{")


def index_tokens(text: Column) -> Column:
    """Tokens of a document: byte separators, ASCII lower case, first byte a letter or digit."""
    return F.filter(token_parts(text), is_token)


def query_tokens(text: Column, canonical: bool = True, underscore: bool = True) -> Column:
    """Tokens of a query: as for documents, or (not canonical) with case kept and fewer separators."""
    if canonical:
        return index_tokens(text)
    return F.filter(F.split(_bytes(text), _class(QUERY_HIGH_BYTES, underscore)), lambda t: t != "")


def between_tags(text: Column, begin: str, end: str) -> Column:
    """What stands between the first `begin` and the next `end`; null if either is missing."""
    rest = F.when(F.contains(text, F.lit(begin)), F.expr("1"))
    start = F.locate(begin, text) + len(begin)
    tail = F.substr(text, start)
    at = F.locate(end, tail)
    return F.when(rest.isNotNull() & (at > 0), F.substr(tail, F.lit(1), at - 1))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def strip_id_prefix(line: Column) -> Column:
    """The line without what precedes its first tab."""
    return F.regexp_replace(line, r"^[^\t]*\t", "")


def with_prefix(text: Column, kind: str) -> Column:
    """The encoder's instruction prefix: kind is `query` or `passage`; missing text is empty."""
    if kind not in ("query", "passage"):
        raise ValueError(f"unknown kind {kind!r}")
    return F.concat(F.lit(f"{kind}: "), F.coalesce(text.cast("string"), F.lit("")))


def line_kind(line: Column) -> Column:
    """How a result line is read by its number of parts: `full` with content, `score` without, `other`."""
    parts = F.size(F.split(line, ", "))
    return F.when(parts == 3, "full").when(parts == 2, "score").otherwise("other")


def result_line(doc_id: Column, score: Column, content: Column | None = None) -> Column:
    """One line of a result listing; commas in the content become spaces."""
    head = F.concat(F.lit("DocId: "), doc_id.cast("string"), F.lit(", Score: "), F.format_string("%.6f", score))
    return head if content is None else F.concat(head, F.lit(", Content: "), F.translate(content, ",", " "))


def parse_result_line(line: Column) -> Column:
    """struct(doc_id, score, content, parts) of a result line; content is null if absent."""
    return F.struct(
        F.regexp_extract(line, r"DocId: (\d+)", 1).try_cast("long").alias("doc_id"),
        F.regexp_extract(line, r"Score: ([-+0-9.eE]+)", 1).try_cast("double").alias("score"),
        F.when(F.contains(line, F.lit("Content: ")), F.regexp_extract(line, r"Content: ([\s\S]*)$", 1)).alias("content"),
        F.size(F.split(line, ", ")).alias("parts"),
    )
