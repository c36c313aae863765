"""Secret scans by patterns and sliding-window entropy, in native expressions only.

Three patterns give the base spans. The method adds spans of kind `entropy`: candidate
strings of 20 or more key characters are read with a window of 20 characters; the window's
sum of c * log2(c) over its character counts c changes by the counts of the entering and
the leaving character alone, in whole millionths. Long candidates are read in parts of
bounded length. A candidate's span runs from its first to its last window whose Shannon
entropy reaches the threshold of its character class. An allow-list suppresses added spans
(never base spans): plain words, identifiers of the UUID form, runs of the alphabet or of
digits, and what overlaps a base span.

Lists of matches are folded in groups of GROUP, so the work grows with a text's length, not
with the square of its matches.

Positions are code points, ends exclusive. Defined cases: null text counts as empty and
has no spans; doc_ids may be null or repeated, each row is scanned on its own. Texts of any
length are scanned whole. An empty table gives an empty result. Columns other than doc_id
and text are ignored, whatever their names are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the leftmost run of 18 or more: a run that is too short holds no other
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Windows that start in one part of a candidate: a position costs the length of its part, not of the candidate.
PART = 128
#: Parts are cut from stretches of so many windows, as finding a place in a text costs its distance from the start.
STRETCH = 128 * PART
#: Matches that are folded at once.
GROUP = 64
#: Bits for hex, for mixed letters and digits, and for letters alone.
LIMITS = {"hex": 3.0, "mixed": 3.8, "letters": 4.1}
ALLOWED = r"^[A-Za-z]?[a-z]+(?:[-_/=+][A-Za-z]?[a-z]+)*+$|^[A-Z]+$|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|abcdefghij|0123456789|^[-_=+/]+$"

_MARK, _OTHER = "\u0001", "\u0002"


def _let(value: Column, body) -> Column:
    """body(value), with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def _groups(items: Column) -> Column:
    """An array in parts of GROUP elements; `items` must be a column or bound by `_let`."""
    starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(GROUP))
    return F.when(F.size(items) > 0, F.transform(starts, lambda at: F.slice(items, at + 1, F.lit(GROUP))))


def _running(values: Column, start: Column, step) -> Column:
    """For each value, what `step` has made of `start` and the values before it. One value a group, so the list is short."""
    return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))


def _spans(text: Column, pattern: str, kind: int, fits=None) -> Column:
    """Spans of a pattern's matches: one pass puts marks around them, the pieces' lengths place them."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,body:string>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), empty.alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        stop = acc["at"] + F.length(piece)
        span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), piece.alias("body"))
        good = acc["hit"] if fits is None else acc["hit"] & fits(piece)
        found = F.when(good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(stop.alias("at"), (~acc["hit"]).alias("hit"), found.alias("found"))

    def moved(span: Column, by: Column) -> Column:
        return F.struct((span["start"] + by).alias("start"), span["kind"].alias("kind"), (span["stop"] + by).alias("stop"), span["body"].alias("body"))

    def placed(pieces: Column) -> Column:
        # matches are every second piece, so each group of an even number of pieces begins between two
        done = F.transform(_groups(pieces), lambda group: F.aggregate(group, zero, step))

        def join(done: Column) -> Column:
            ends = F.transform(done, lambda d: d["at"])
            starts = _running(ends, F.lit(0), lambda at, n: at + n)
            return F.flatten(F.zip_with(done, F.slice(starts, 1, F.size(done)), lambda d, at: F.transform(d["found"], lambda x: moved(x, at))))

        few = F.aggregate(pieces, zero, step, lambda acc: acc["found"])
        return F.when(F.size(pieces) <= 1, empty).when(F.size(pieces) <= GROUP, few).otherwise(_let(done, join))

    return _let(F.split(marked, _MARK), placed)


def _weight(count: Column) -> Column:
    """Millionths of c * log2(c)."""
    table = [0] + [round(1e6 * c * math.log2(c)) for c in range(1, WINDOW + 2)]
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in table]), count + 1)


def _count(body: Column, char: Column) -> Column:
    return F.length(body) - F.length(F.replace(body, char, F.lit("")))


def _candidate(span: Column) -> Column:
    """A candidate's start, its limit and its parts, which share WINDOW - 1 characters with the next."""
    body = span["body"]
    most = {k: round((math.log2(WINDOW) - v) * WINDOW * 1e6) for k, v in LIMITS.items()}
    limit = F.when(body.rlike("^[0-9a-fA-F]+$"), F.lit(most["hex"])).when(body.rlike("[0-9]"), F.lit(most["mixed"])).otherwise(F.lit(most["letters"]))

    def cut(text: Column, size: int) -> Column:
        places = F.sequence(F.lit(0), F.length(text) - WINDOW, F.lit(size))
        return F.transform(places, lambda at: F.struct(at.alias("at"), F.substr(text, at + 1, F.lit(size + WINDOW - 1)).alias("body")))

    def shifted(part: Column, by: Column) -> Column:
        return F.struct((part["at"] + by).alias("at"), part["body"].alias("body"))

    one = F.array(F.struct(F.lit(0).alias("at"), body.alias("body")))
    parts = F.flatten(F.transform(cut(body, STRETCH), lambda long: F.transform(cut(long["body"], PART), lambda part: shifted(part, long["at"]))))
    parts = F.when(F.length(body) < PART + WINDOW, one).otherwise(parts)
    return F.struct(span["start"].alias("start"), limit.alias("limit"), parts.alias("parts"))


def _entropy_span(candidate: Column) -> Column:
    """The candidate's part within windows of high entropy; start < 0 if there is none."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def scan(part: Column) -> Column:
        body = part["body"]

        def step(acc: Column, i: Column) -> Column:
            full = i > WINDOW
            start = F.greatest(i - WINDOW + 1, F.lit(1))
            kept = F.substr(body, start, i - start)
            leaves, enters = F.substr(body, i - WINDOW, F.lit(1)), F.substr(body, i, F.lit(1))
            out, into = _count(kept, leaves), _count(kept, enters)
            total = acc["sum"] + _weight(into + 1) - _weight(into)
            total = F.when(full, total - _weight(out + 1) + _weight(out)).otherwise(total)
            hot = (i >= WINDOW) & (total <= candidate["limit"])
            first = F.when(hot & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"])
            return F.struct(total.alias("sum"), first.alias("first"), F.when(hot, i).otherwise(acc["last"]).alias("last"))

        end = lambda acc: F.struct(acc["first"].alias("first"), (part["at"] + acc["first"]).alias("start"), (part["at"] + acc["last"]).alias("stop"))
        return F.aggregate(F.sequence(F.lit(1), F.length(body)), zero, step, end)

    hits = F.filter(F.transform(candidate["parts"], scan), lambda x: x["first"] >= 0)
    at = F.transform(F.array(hits), lambda h: F.struct(
        F.when(F.size(h) == 0, F.lit(-1)).otherwise(candidate["start"] + F.try_element_at(h, F.lit(1))["start"]).alias("start"),
        F.lit(4).alias("kind"), (candidate["start"] + F.try_element_at(h, F.lit(-1))["stop"]).alias("stop"), F.lit("").alias("body")))
    return at[0]


def _clear(base: Column, added: Column) -> Column:
    """The added spans that overlap no base span.

    All spans are put in order, base spans by their start, added ones by their stop and first among equals. So the
    base spans before an added one are those that start before its end; it overlaps one if their largest stop is
    beyond its start.
    """
    event = lambda s, at, own: F.struct(s[at].alias("at"), F.lit(own).alias("own"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s, "start", 1)), F.transform(added, lambda s: event(s, "stop", 0))))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,body:string>>")

    def step(acc: Column, e: Column) -> Column:
        span = F.struct(e["start"].alias("start"), e["kind"].alias("kind"), e["stop"].alias("stop"), F.lit("").alias("body"))
        keep = (e["own"] == 0) & (acc["top"] <= e["start"])
        top = F.when(e["own"] == 1, F.greatest(acc["top"], e["stop"])).otherwise(acc["top"])
        return F.struct(top.alias("top"), F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def swept(groups: Column) -> Column:
        tops = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda e: F.when(e["own"] == 1, e["stop"]).otherwise(F.lit(-1)))))
        before = _running(tops, F.lit(-1), lambda top, x: F.greatest(top, x))
        begin = lambda top: F.struct(top.alias("top"), none.alias("found"))
        return F.flatten(F.zip_with(groups, F.slice(before, 1, F.size(groups)), lambda g, top: F.aggregate(g, begin(top), step, lambda acc: acc["found"])))

    swept_whole = lambda all_: F.when(F.size(all_) <= GROUP, F.aggregate(all_, F.struct(F.lit(-1).alias("top"), none.alias("found")), step, lambda acc: acc["found"])).otherwise(_let(_groups(all_), swept))
    # without base spans nothing can overlap
    return F.when(F.size(added) == 0, none).when(F.size(base) == 0, added).otherwise(_let(events, swept_whole))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    long_value = lambda piece: F.length(F.regexp_extract(piece, ASSIGN, 2)) >= 12
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,body:string>>")
    rows = rows.select(
        "doc_id",
        _spans(F.col("text"), ASSIGN, 1, long_value).alias("assign"),
        F.when(F.contains(F.col("text"), F.lit("AKIA")), _spans(F.col("text"), ACCESS, 2)).otherwise(none).alias("access"),
        _spans(F.col("text"), HEX, 3).alias("hex"),
        _spans(F.col("text"), CANDIDATE, 4, lambda piece: ~piece.rlike(ALLOWED)).alias("strings"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    rows = rows.withColumn("added", F.when(F.size("strings") > 0, F.filter(F.transform(F.transform("strings", _candidate), _entropy_span), lambda s: s["start"] >= 0)).otherwise(none))
    rows = rows.withColumn("every", F.array_sort(F.concat("base", _clear(F.col("base"), F.col("added")))))
    return rows.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("every")).alias("spans"),
    )
