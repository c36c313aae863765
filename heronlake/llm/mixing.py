"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share a
multiple of all words; a target stops at twice its source's size and the excess is shared
again by weight until none is above.

Rates: among all rates in [0, 2] whose words meet a source's target, the ones of largest
(two-sided) entropy around 1 are 2 / (1 + exp(-tilt * size / mean size)), an exponential
tilt of the odds. The tilt solves the convex dual of the token constraint. Newton steps,
kept within a bracket and begun at the tilt that equal sizes would need, are grouped sums over
(source, size, number of documents), so an iteration reads one row per distinct size. Sums are
decimal, so reruns agree exactly. Should STEPS not meet the tolerance, a warning says so; the
copies end at the target all the same.

Copies: a document gets the whole part of its rate. Its fraction orders the documents of a
source by hash / fraction (sequential Poisson sampling); extra copies go along that order
until the source has its target, and the last one is cut to the words still missing. The
place in the order comes from sums over 256 ranges of the key, over 256 ranges of the one
where the copies end, and so on, three times; a sixteen-millionth of a source is sorted.

Defined cases: null text has size 0 and gets nothing; null sources are one source. Rows
that repeat doc_id, source and size share what they get, rounded down; null doc_ids are
such too. Empty sources have target 0, and an empty table gives an empty result. Texts of any
length count whole. `mix` keeps all columns, whatever their names are; `mix_rates` ignores
those other than doc_id, source and text.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.sides import BROADCAST_BYTES, bounded, own
from heronlake.session import cut_lineage

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Ranges of the key at each level, and levels.
RANGES, LEVELS = 256, 3
#: Newton stops when every source is this close to its target, relative to it.
TOLERANCE, STEPS = 1e-6, 60


def size_of(text: Column) -> Column:
    """Number of words: runs of characters other than \\x20 and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """`sources` with its place (from 0) in code-point order, nulls last, without sorting in one task."""
    order = F.col("source").asc_nulls_last()
    dealt = sources.repartitionByRange(order).sortWithinPartitions(order)
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()))
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("nth").alias("base"))
    before = F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)")
    parts = parts.withColumn("before", before)  # one row per partition
    return dealt.join(F.broadcast(parts), "part").select("source", "source_size", "n_docs", (F.col("nth") - F.col("base") + F.col("before")).alias("place"))


def _with_targets(sources: DataFrame) -> DataFrame:
    weights = F.array(*map(F.lit, WEIGHTS))
    sources = sources.withColumn("weight", F.element_at(weights, (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    sources = cut_lineage(sources)
    total = SHARE * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, seen = 0.0, None
    while True:  # each turn stops more sources, or ends
        full = F.col("weight") * level > CAP * F.col("source_size")
        got = sources.agg(
            F.sum(F.when(full, CAP * F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if got[1] is None or got[2] == seen:
            break
        seen, level = got[2], (total - (got[0] or 0)) / got[1]
    target = F.least(F.col("weight") * level, (CAP * F.col("source_size")).cast("double"))
    return sources.withColumn("target", target)


def _rate(tilt: str, size: str, mean: str) -> Column:
    return F.expr(f"2 / (1 + exp(-greatest(-700, least(700, {tilt} * {size} / {mean}))))")


def _with_tilts(sources: DataFrame, sizes: DataFrame) -> DataFrame:
    """`sources` with the tilt that meets its target; null where every document is taken twice."""
    sources = sources.withColumn("mean", F.col("source_size") / F.col("n_docs"))
    state = sources.filter(f"source_size > 0 and target < {CAP} * source_size").selectExpr(
        "place", "target", "mean", f"ln(greatest(target, 1e-9) / ({CAP} * source_size - target)) as tilt", "-1e9D as low", "1e9D as high", "1.0D as miss"
    )
    state = cut_lineage(state)
    # one row a source in all that is joined here: if the first table is small enough for broadcasts, all are
    small = _small(state)
    for _ in range(STEPS):
        rate = _rate("tilt", "size", "mean")
        terms = sizes.join(small(state), "place").withColumn("rate", rate)
        words, slope = "size * n * rate", "size * n * (size / mean) * rate * (1 - rate / 2)"
        sums = terms.groupBy("place").agg(
            F.expr(f"cast(sum(cast({words} as decimal(32, 6))) as double)").alias("words"),
            F.expr(f"cast(sum(cast({slope} as decimal(32, 6))) as double)").alias("slope"),
        )
        moved = state.join(small(sums), "place").selectExpr(
            "place", "target", "mean", "tilt as was", "if(words < target, tilt, low) as low", "if(words > target, tilt, high) as high",
            "abs(words - target) / greatest(target, 1) as miss",
            "tilt - greatest(-4, least(4, (words - target) / greatest(slope, 1e-9))) as step",
        )
        inside = "if(low < step and step < high, step, if(low > -1e9 and high < 1e9, (low + high) / 2, step))"
        moved = moved.selectExpr(
            "place", "target", "mean", f"if(miss <= {TOLERANCE}, was, {inside}) as tilt", "low", "high", "miss"
        )
        state = cut_lineage(moved)
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= TOLERANCE:
            break
    else:
        warnings.warn(f"a source's words miss its target by more than {TOLERANCE} after {STEPS} steps", stacklevel=2)
    return sources.join(small(state.select("place", "tilt")), "place", "left")


def _small(sources: DataFrame):
    """F.broadcast if a table of one row a source is small enough for it, with twelve columns of 8 bytes at most; else nothing."""
    most = BROADCAST_BYTES // (16 + 12 * 8)
    return F.broadcast if sources.limit(most + 1).count() <= most else lambda rows: rows


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds each row's whole copies and its place in the order of extra copies."""
    rate = F.when(F.col("tilt").isNull(), F.lit(float(CAP))).otherwise(_rate("tilt", "size", "mean"))
    rows = rows.withColumn("whole", F.floor(rate).cast("long")).withColumn("part", rate - F.floor(rate))
    chance = (F.pmod(F.xxhash64("doc_id", "place"), F.lit(1 << 50)) + 1) / float(1 << 50)
    key = F.when(F.col("part") > 0, chance / F.col("part"))
    rows = rows.withColumn("key", F.coalesce(key / (1 + key), F.lit(1.0)))
    return rows.withColumn("range", F.floor(F.col("key") * RANGES**LEVELS).cast("int"))


def plan(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source: its size, target, tilt and the range where its extra copies end; and the
    extra words of the rows of that range. `sized`: doc_id, source, size."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = cut_lineage(_with_targets(_ranked(sources)))
    counted = sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    other = bounded(sources.select("source", "place"))
    sizes = cut_lineage(counted.alias("a").join(other.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("place", "size", "n"))
    sources = cut_lineage(_with_tilts(sources, sizes))
    rows = _keyed(_attach(sized, sources)).filter("size > 0")
    end, small = None, _small(sources)
    for level in range(1, LEVELS + 1):
        width = RANGES ** (LEVELS - level)
        if end is not None:  # of the ranges so far, only the one where a source's copies end
            rows = rows.drop("left_words", "upper").join(small(end), "place").filter(f"range div {width * RANGES} = upper")
            rows = cut_lineage(rows) if level == 2 else rows
        sums = rows.withColumn("part", F.expr(f"range div {width}")).groupBy("place", "part").agg(
            F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("base")
        )
        sums = cut_lineage(sums)
        if end is None:
            base = sums.groupBy("place").agg(F.sum("base").alias("base"))
            need = sources.join(small(base), "place").selectExpr("place", "greatest(0, cast(round(target) as bigint) - base) as left_words")
        else:
            need = end.select("place", "left_words")
        running = sums.selectExpr("place", "part", "words", "sum(words) over (partition by place order by part) - words as before")  # RANGES rows a source
        end = running.join(small(need), "place").filter("before <= left_words and left_words < before + words")
        end = cut_lineage(end.selectExpr("place", "part as upper", "left_words - before as left_words"))
    sources = cut_lineage(sources.join(small(end.selectExpr("place", "upper as end_range", "left_words")), "place", "left"))
    last = rows.drop("left_words", "upper").join(small(end), "place").filter("range = upper").groupBy("place", "key", "doc_id", "size", "left_words").agg(F.count("*").alias("rows"))
    last = last.selectExpr(
        "place", "doc_id", "size", "rows", "left_words",
        "sum(size * rows) over (partition by place order by key, doc_id, size) - size * rows as before",
    ).selectExpr("place", "doc_id", "size", "greatest(0, least(size * rows, left_words - before)) div rows as extra")
    return sources, cut_lineage(last.filter("extra > 0"))


def _attach(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """`rows` (with source) with their source's columns but its name, n_docs and weight."""
    other = bounded(sources.withColumnRenamed("source", "of").drop("n_docs", "weight"))
    return rows.join(other, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def take(rows: DataFrame, sources: DataFrame, last: DataFrame) -> DataFrame:
    """`rows` (doc_id, source, size, and `row` or nothing else) with source_size, target and taken."""
    keep = rows.columns
    keyed = _keyed(_attach(rows, sources))
    some = bounded(last.select(F.col("place").alias("p"), F.col("doc_id").alias("d"), F.col("size").alias("s"), "extra"))
    same = (F.col("place") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("s"))
    keyed = keyed.join(some, same & (F.col("range") == F.col("end_range")), "left")
    extra = F.expr("case when range < coalesce(end_range, 0) then size when range = end_range then coalesce(extra, 0) else 0 end")
    return keyed.withColumn("taken", F.col("whole") * F.col("size") + extra).select(*keep, "source_size", "target", "taken")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"))


def mix_rates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = cut_lineage(_sized(docs))
    return take(sized, *plan(sized)).drop("source")


def mix(docs: DataFrame) -> DataFrame:
    """The input's columns, each row as often as the mix takes it; a cut copy has the first words, one space between."""
    rows = _sized(docs, F.struct(*own(docs)).alias("row"))  # so that no name clashes
    taken = take(rows, *plan(cut_lineage(_sized(docs)))).filter("taken > 0")
    copies = taken.select("row", F.explode(F.expr(
        "concat(array_repeat(size, cast(taken div size as int)), if(taken % size > 0, array(taken % size), array()))"
    )).alias("words"), "size")
    text = F.col("row").getField("text")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " "))
    return copies.select(*[(F.coalesce(cut, text) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
