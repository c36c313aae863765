"""Chat formatting into budgeted, turn-aligned windows, in native expressions only.

A turn is written ``[INST]role[/INST]text</s>``. Inside roles and texts ``\\``, ``<`` and
``[`` become ``\\b``, ``\\l`` and ``\\i``, so control strings there can't be taken for marks
and `unescape` restores every text.

Turns are ordered by their number, then by the first SHORT characters of role and text, then
by a hash of both; only the order counts, not the numbers. The prefix sum of the tokens
before a turn puts it into a block of BLOCK budgets. A conversation that may be longer than
one block gets its prefix sums in two steps, over ranges of its turns, so no task needs a
whole conversation; a shorter one is one block and needs none. Within a block a window goes
on while its turns' tokens stay within the budget less the system turn and the history
allowance; a block's start also starts a window.

Each window repeats the conversation's system turn (its first turn, if that has the role
``system``) and the last turns before it that fit the history allowance, also across the
block's start; where a turn needs more room, the history shrinks first. Repeated turns are
masked; of the new turns the assistant's texts bear loss.

Tokens: `tokens` names a column with each turn's count (null or under 1: 1). Without it a
turn's tokens are the runs of letters, digits and underscores of any script and the other
signs of its text, and 4 for its marks.

Defined cases: null roles and texts count as empty; null turns come last; turns that tie
are ordered as said above, equal ones are turns of their own, and any number of them may be
equal. Rows whose conv_id is null form one conversation. A turn that exceeds the budget with
the system turn alone has a window of its own, marked over_budget; nothing is cut, however
long a text is. An empty table gives an empty result. Columns other than those named are
ignored, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.sides import bounded
from heronlake.session import cut_lineage

#: Budgets' worth of tokens in a block; characters of role and text that order turns.
BLOCK, SHORT = 64, 64
LAST = (1 << 63) - 1
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_KEY = ("turn", "r", "t", "h")


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\i")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("<", "\\l"), ("[", "\\i"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _let(value: Column, body) -> Column:
    """body(value), with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(CLOSE))


def _written(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), escape(t["text"]), F.lit(END))), "")


def default_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")).cast("long") + 4


def _rows(conversations: DataFrame, tokens: str | None) -> DataFrame:
    """conv_id, the four columns of the order, role, text and tokens of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    count = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(1)), F.lit(1)).cast("long") if tokens else default_tokens(text)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.substring(role, 1, SHORT).alias("r"), F.substring(text, 1, SHORT).alias("t"), F.xxhash64(role, text).alias("h"),
        role.alias("role"), text.alias("text"), count.alias("tokens"),
    )


def _same(a: str, b: str, *more: str) -> Column:
    """Equality of conv_id (null too) and of `more`, between two aliased sides."""
    same = F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    for c in more:
        same = same & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return same


def _places(turns: DataFrame) -> DataFrame:
    """(conv_id, the order's columns, n equal turns, tokens, before): the tokens before the first of the equal turns."""
    order = ["conv_id", *_KEY]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()))
    parts = dealt.groupBy("conv_id", "part").agg(F.sum(F.col("n") * F.col("tokens")).alias("all"))
    ahead = F.expr("coalesce(sum(all) over (partition by conv_id order by part rows between unbounded preceding and 1 preceding), 0)")
    parts = cut_lineage(parts.select("conv_id", "part", ahead.alias("ahead")))  # one row per range and conversation
    own = F.expr("sum(n * tokens) over (partition by part, conv_id order by nth rows unbounded preceding) - n * tokens")
    summed = dealt.withColumn("own", own).alias("a").join(bounded(parts).alias("b"), _same("a", "b", "part"))
    return summed.select(*[f"a.{c}" for c in order], "n", "tokens", (F.col("own") + F.col("ahead")).alias("before"))


def _long_blocks(rows: DataFrame, size: int, history: int) -> tuple[DataFrame, DataFrame]:
    """Turns of long conversations with their block, those that the next block may repeat in both; and the system turns."""
    order = ["conv_id", *_KEY]
    places = cut_lineage(_places(rows.groupBy(*order).agg(F.count("*").alias("n"), F.max("tokens").alias("tokens"))))
    texts = rows.groupBy(*order).agg(F.first("role").alias("role"), F.first("text").alias("text"))  # equal turns are one row
    placed = texts.alias("a").join(places.alias("b"), _same("a", "b", *_KEY)).select("a.*", "n", "tokens", "before")
    opening = placed.filter("before = 0").groupBy("conv_id").agg(F.min_by(F.struct(*_KEY, "role", "text", "tokens"), F.struct(*_KEY)).alias("opening"))
    opening = cut_lineage(opening.filter("opening.role = 'system'"))  # at most one row per long conversation
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.withColumn("at", F.col("before") + F.col("copy") * F.col("tokens")).withColumn("block", F.floor(F.col("at") / size).cast("long"))
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("past"))
    again = F.struct((F.col("block") + 1).alias("block"), F.lit(True).alias("past"))
    near = F.col("at") >= (F.col("block") + 1) * size - history
    each = each.withColumn("to", F.explode(F.when(near, F.array(own, again)).otherwise(F.array(own))))
    return each.select("*", F.col("to.block").alias("in_block"), F.col("to.past").alias("past")).drop("block", "to").withColumnRenamed("in_block", "block"), opening


def _blocks(rows: DataFrame, size: int, history: int) -> DataFrame:
    """(conv_id, block, turns, system): arrays of the turns in order, repeated ones marked `past`, and of the system turn."""
    fields = [*_KEY, "role", "text", "tokens", "past"]
    gather = F.array_sort(F.collect_list(F.struct(F.col("at"), *fields))).alias("turns")
    whole = rows.withColumn("past", F.lit(False)).withColumn("at", F.lit(0).cast("long")).withColumn("block", F.lit(0).cast("long"))
    # an upper bound of a conversation's tokens, from lengths alone, tells the long ones
    most = rows.groupBy("conv_id").agg(F.sum(F.greatest("tokens", F.octet_length("text") + 4)).alias("most"))
    long = cut_lineage(most.filter(F.col("most") > size).select("conv_id"))
    first = F.col("turns")[0]
    none = F.slice("turns", 1, 0)
    if long.isEmpty():
        blocks = whole.groupBy("conv_id", "block").agg(gather)
        return blocks.select("conv_id", "block", "turns", F.when(first["role"] == "system", F.slice("turns", 1, 1)).otherwise(none).alias("system"))
    ids = bounded(long)
    short = whole.alias("a").join(ids.alias("b"), _same("a", "b"), "left_anti")
    placed, opening = _long_blocks(rows.alias("a").join(ids.alias("b"), _same("a", "b"), "left_semi"), size, history)
    columns = ["conv_id", "block", "at", *fields]
    blocks = short.select(columns).unionByName(placed.select(columns)).groupBy("conv_id", "block").agg(gather)
    blocks = blocks.filter(F.exists("turns", lambda t: ~t["past"]))
    joined = blocks.alias("a").join(bounded(opening).alias("b"), _same("a", "b"), "left")
    said = F.struct(F.lit(0).cast("long").alias("at"), *[F.col(f"opening.{c}").alias(c) for c in fields[:-1]], F.lit(False).alias("past"))
    system = F.when(F.col("opening").isNotNull(), F.array(said)).when((F.col("a.block") == 0) & (first["role"] == "system"), F.slice("turns", 1, 1)).otherwise(none)
    return joined.select("a.conv_id", "a.block", "turns", system.alias("system"))


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens: str | None = None) -> DataFrame:
    """One row per window: conv_id, block, window, n_context (repeated turns at its head),
    n_new, formatted, loss_spans (start, stop; code points of formatted), n_tokens, over_budget."""
    blocks = _blocks(_rows(conversations, tokens), BLOCK * budget, history)
    fixed = F.coalesce(F.try_element_at("system", F.lit(1))["tokens"], F.lit(0).cast("long"))
    opens = (F.size("system") > 0) & (F.col("block") == 0)  # the system turn is the block's first
    skip = F.size(F.filter("turns", lambda t: t["past"])) + F.when(opens, 1).otherwise(0)
    blocks = blocks.select("conv_id", "block", "turns", "system", fixed.alias("fixed"), opens.alias("opens"), skip.alias("skip"))
    room = F.greatest(F.lit(budget - history).cast("long") - F.col("fixed"), F.lit(1).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.col("skip").alias("i"), F.slice(F.array(F.lit(0)), 1, 0).alias("cuts"), room.alias("room"))

    def grow(acc: Column, n: Column) -> Column:
        """`cuts`: the places where windows start."""
        starts = (F.size(acc["cuts"]) == 0) | (acc["used"] + n > acc["room"])
        cuts = F.when(starts, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"])
        return F.struct(F.when(starts, n).otherwise(acc["used"] + n).alias("used"), (acc["i"] + 1).alias("i"), cuts.alias("cuts"), acc["room"].alias("room"))

    sizes = F.transform(F.slice("turns", F.col("skip") + 1, F.size("turns")), lambda t: t["tokens"])
    # a conversation of a system turn alone is one window without new turns
    cuts = F.aggregate(sizes, zero, grow, lambda acc: F.when(F.size(acc["cuts"]) == 0, F.array(acc["i"])).otherwise(acc["cuts"]))
    bounds = _let(cuts, lambda c: F.transform(c, lambda start, i: F.struct(
        i.alias("window"), start.alias("start"), F.coalesce(F.try_element_at(c, i + 2), F.size("turns")).alias("stop"))))
    reach = F.when(F.col("opens"), 1).otherwise(0)  # the system turn is not repeated as history
    cut = F.explode(F.transform(bounds, lambda w: F.struct(
        w["window"].alias("window"), F.slice("turns", w["start"] + 1, w["stop"] - w["start"]).alias("new"),
        _let(F.greatest(w["start"] - history, reach), lambda a: F.reverse(F.slice("turns", a + 1, w["start"] - a))).alias("before"))))
    windows = blocks.select("conv_id", "block", "system", "fixed", "opens", cut.alias("w")).select("conv_id", "block", "system", "fixed", "opens", "w.*")
    total = F.aggregate(F.transform("new", lambda t: t["tokens"]), F.lit(0).cast("long"), lambda s, n: s + n)
    windows = windows.withColumn("n_own", total)
    spare = F.least(F.lit(history).cast("long"), F.lit(budget).cast("long") - F.col("fixed") - F.col("n_own"))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on"), spare.alias("spare"))

    def back(acc: Column, n: Column) -> Column:
        on = acc["on"] & (acc["used"] + n <= acc["spare"])
        return F.struct(F.when(on, acc["used"] + n).otherwise(acc["used"]).alias("used"), F.when(on, acc["n"] + 1).otherwise(acc["n"]).alias("n"), on.alias("on"), acc["spare"].alias("spare"))

    past = F.aggregate(F.transform("before", lambda t: t["tokens"]), state, back)
    windows = windows.select("*", past.alias("kept"))
    lead = F.concat("system", F.reverse(F.slice("before", F.lit(1), F.col("kept.n"))))
    opening = F.col("opens") & (F.col("window") == 0)
    windows = windows.select(
        "conv_id", "block", "window", "new", (F.size("system") + F.col("kept.n") - F.when(opening, 1).otherwise(0)).alias("n_context"),
        (F.size("new") + F.when(opening, 1).otherwise(0)).alias("n_new"), _written(lead).alias("lead"), (F.col("fixed") + F.col("kept.used") + F.col("n_own")).alias("n_tokens"),
    )
    begin = F.struct(F.length("lead").alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def mask(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(escape(t["text"]))
        span = F.array(F.struct(start.alias("start"), end.alias("stop")))
        return F.struct((end + len(END)).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return windows.select(
        "conv_id", "block", "window", "n_context", "n_new", F.concat("lead", _written(F.col("new"))).alias("formatted"),
        F.aggregate("new", begin, mask, lambda acc: acc["spans"]).alias("loss_spans"), "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per window, from its formatted text alone: the new turns and what lies under the loss mask."""
    parts = F.split("formatted", END)
    parts = F.slice(parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context"))

    def turn(part: Column) -> Column:
        two = F.split(F.substr(part, F.lit(len(OPEN) + 1)), r"\[/INST\]")
        return F.concat(unescape(two[0]), F.lit("\n"), unescape(two[1]), F.lit("\n"))

    under = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    return windows.select(
        "conv_id", "block", "window", F.size(parts).alias("n_turns"), F.array_join(F.transform(parts, turn), "").alias("turns"),
        F.array_join(under, "").alias("loss"), F.length("formatted").alias("n_chars"),
    )


def digest(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Per conversation, read back from the formatted windows: what its turns and its loss mask hold.

    The digests are of whole conversations, so here a conversation's text does come together.
    """
    found = read_back(format_windows(conversations, budget, history))
    parts = F.array_sort(F.collect_list(F.struct("block", "window", "turns", "loss")))
    whole = found.groupBy("conv_id").agg(
        F.sum("n_turns").cast("long").alias("n_turns"), parts.alias("parts"), F.sum("n_chars").cast("long").alias("formatted_chars")
    )
    turns, loss = F.array_join(F.col("parts.turns"), ""), F.array_join(F.col("parts.loss"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
