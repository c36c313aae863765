"""N-gram Jaccard self-join: rare-first prefix filtering, then one check per pair.

Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of distinct
k-word shingles. Documents with equal sets form a class; classes are what is joined.

1. Every shingle gets a place in one global order, rare ones first. Shingles fall into tiers by
   hash; of a set, the first tiers that can fill its prefix are counted: a quarter of a long
   text's shingles, all of a very short one's. Within a tier the number of sets that gave a
   shingle to be counted decides. Shingles that some task finds in HEAVY sets of one stretch of
   the corpus, reading all documents, come last, ordered by that number, and are never grouped:
   so a counted shingle's group has fewer than HEAVY sets a stretch. Any global order gives
   exact results; the order sets only the cost.
2. A class's prefix is its first n - ceil(percent * n / 100) + 1 shingles. Linked classes
   share a prefix shingle. A class whose prefix holds shingles of its own only is done.
3. Prefixes are joined on their shingles under three filters: length; position (at a
   pair's first common shingle, what is left of both sets must suffice); and suffix (the
   sets are parted by 512 hash ranges; each range where one set has an odd number of
   shingles and the other an even one holds at least one that they do not share).
4. Pairs that pass are compared once, on their whole sets.

Only links that can change the components are looked for: in each round, the members of a
prefix shingle's bucket meet the bucket's first few members (1, then 16, 256, ...), pairs
that are in one component already are left out, and buckets that are within one component
or have been covered retire. Rounds go on until all have, so components are exact, while
thousands of copies of one text cost about one comparison each instead of all pairs.
`link_counts` does the whole join: classes of different components don't link, so it then
compares all pairs of classes within each component, by blocks, and counts every link.

Shingles are compared as 64-bit hashes and sets of one class by 128 bits. Counted shingles carry
64 bits of their class's name; classes that share these get other ones until all differ.

Defined cases: null and blank texts have the empty set and link with nothing, not even
each other; a text of fewer than k words is one shingle. Null doc_ids take part but never
name a component unless all of its doc_ids are null. Repeated rows give repeated results.
Texts of any length are hashed whole, in blocks. An empty table gives an empty result.
Columns other than doc_id and text are ignored, whatever their names are.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm import worker
from heronlake.llm.components import components
from heronlake.llm.shingles import mix, shingle_sets
from heronlake.llm.sides import bounded, free_names
from heronlake.session import cut_lineage

#: Of 256 hash values of a shingle, those below are in the first tier, the second, the third.
TIERS = (64, 128, 256)
#: A shingle in HEAVY sets of a stretch of STRETCH shingles is very frequent; the HEAVY_MOST most frequent of them come last.
HEAVY, STRETCH, HEAVY_MOST = 16, 1 << 22, 100_000
#: How much further into the buckets each round reaches.
REACH = 16
#: The first members of buckets of more members are found in two steps, over so many parts.
LARGE, PARTS = 4096, 64
#: Classes of a component that are compared with as many others in one group, about.
BLOCK = 256

#: Columns of the parities of a set's 512 hash ranges.
PARITY = [f"s{i}" for i in range(8)]

_SET = "doc_id long, n int, k1 long, k2 long, " + ", ".join(f"{c} long" for c in PARITY) + ", c0 int, c1 int, c2 int, counted array<long>, rest array<long>, text_key long"


def _keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        u = s.view(np.uint64)
        return tuple(int(np.add.reduce(mix(u + np.uint64(c))).view(np.int64)) for c in (1, 0x51ED270B))


def _parities(s: np.ndarray) -> list[int]:
    """For each of 512 hash ranges, whether the set holds an odd number of its values."""
    counts = np.bincount((s.view(np.uint64) >> np.uint64(55)).astype(np.int64), minlength=512)
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8").tolist()


def _apart() -> str:
    """SQL for the least size of the symmetric difference of two sets, from their parities."""
    return " + ".join(f"bit_count({c} ^ {c}_b)" for c in PARITY)


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _ahead(s: np.ndarray, need: int, heavy: np.ndarray, rank: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The part of a set that its prefix of `need` shingles is made of: how many shingles of each tier
    are to be counted, these shingles, and the very frequent ones that may follow."""
    last = s[:0]
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        hot = heavy[at] == s
        if hot.any():
            last = s[hot][np.argsort(rank[at[hot]])]
            s = s[~hot]
    tier = s & 255
    upto = [int(np.count_nonzero(tier < t)) for t in TIERS]
    used = next((i for i, n in enumerate(upto) if n >= need), len(TIERS) - 1)
    sizes = [n - m if i <= used else 0 for i, (n, m) in enumerate(zip(upto, [0, *upto], strict=False))]
    return sizes, s[tier < TIERS[used]], last[: max(0, need - upto[used])]


def _describe(k: int, percent: int, heavy: np.ndarray, rank: np.ndarray):
    """Sets' sizes, names and the parts that prefixes are made of. `heavy`: sorted shingles; `rank`: their places, rarest first."""
    longs, ints = pa.int64(), pa.int32()
    types = [longs, ints, longs, longs, *[longs] * len(PARITY), ints, ints, ints, pa.list_(longs), pa.list_(longs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget("ngram_join")
        seen: set[int] = set()  # a task describes a set once, as long as it remembers it
        for batch in worker.slices(batches, size=4 << 20):
            rows: list[list] = [[] for _ in types]
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(worker.texts(batch), k), strict=True):
                name, parities = _keys(s), _parities(s)
                sizes, counted, rest = [0, 0, 0], None, None
                if len(s) and (both := name[0] << 64 | name[1] & (1 << 64) - 1) not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(both)
                    sizes, counted, rest = _ahead(s, _prefix(len(s), percent), heavy, rank)
                for to, x in zip(rows, (doc, len(s), *name, *parities, *sizes, counted, rest), strict=True):
                    to.append(x)
            columns = [*[pa.array(r, t) for r, t in zip(rows, types, strict=True)], batch.column("text_key")]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SET.split(", ")])
        worker.give_back()

    return run


def _whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget("ngram_join")
        for batch in worker.slices(batches, size=4 << 20):
            sets = shingle_sets(worker.texts(batch), k)
            names = [_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                ["k1", "k2", "shingles"],
            )
        worker.give_back()

    return run


def _heavy_of(k: int):
    """(token, n) of the shingles in HEAVY different sets, or more, of a stretch of STRETCH shingles."""

    def found(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n >= HEAVY
        return pa.RecordBatch.from_arrays([pa.array(tokens[often]), pa.array(n[often].astype(np.int64))], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget("ngram_join")
        held, size, names = [np.zeros(0, np.int64)], 0, set()
        for batch in worker.slices(batches, size=4 << 20):
            for s in shingle_sets(worker.texts(batch), k):
                name = (len(s), int(s.sum()))
                if name in names:
                    continue
                names.add(name)
                held.append(s)
                size += len(s)
                if size >= STRETCH:
                    yield found(held)
                    held, size, names = held[:1], 0, set()
        yield found(held)
        worker.give_back()

    return run


def _heavy_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The very frequent shingles, sorted, and their places in the order, rarest first; HEAVY_MOST (1.6 MB) at most."""
    found = docs.select("text").mapInArrow(_heavy_of(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "token").limit(HEAVY_MOST).collect()
    token, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    order = np.argsort(token)
    token, n = token[order], n[order]
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(token))
    return token, rank


def _short_names(sets: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with `name`, 64 bits that no two classes share: k1, and other bits for the few classes whose k1 is not theirs alone."""
    classes, salt = classes.withColumn("name", F.col("k1")), 0
    while True:
        twice = cut_lineage(classes.groupBy("name").count().filter("count > 1").select("name", F.lit(True).alias("twice")))
        if twice.isEmpty():
            break
        salt += 1
        other = F.when(F.col("twice"), F.xxhash64(F.lit(salt), "k1", "k2")).otherwise(F.col("name"))
        classes = cut_lineage(classes.join(bounded(twice), "name", "left").withColumn("name", other).drop("twice"))
    if not salt:
        return sets.withColumn("name", F.col("k1")), classes
    renamed = cut_lineage(classes.filter("name <> k1").select("k1", "k2", F.col("name").alias("other")))
    return sets.join(bounded(renamed), ["k1", "k2"], "left").withColumn("name", F.coalesce("other", "k1")).drop("other"), classes


def _prefixes(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(token, cid, n, pos) of the prefix shingles that more than one class may share."""
    counted = sets.select(F.explode("counted").alias("token"), "name")
    bucket = "over (partition by token)"
    shared = (
        counted.selectExpr("token", "name", f"count(*) {bucket} as df", f"min(name) {bucket} as low", f"max(name) {bucket} as high")
        .filter("low < high").select("token", "name", "df").distinct()
    )
    tier = f"if(token & 255 < {TIERS[0]}, 0, if(token & 255 < {TIERS[1]}, 1, 2))"
    own = "over (partition by cid, tier order by df, token)"
    ahead = (
        shared.join(classes, "name").selectExpr("token", "df", "cid", "n", "c0", "c1", "c2", f"{tier} as tier")
        .selectExpr("token", "cid", "n", "c0", "c1", "c2", "tier", f"row_number() {own} as nth", "count(*) over (partition by cid, tier) as n_shared")
        # a tier's shingles of one class alone come before those that others have too
        .selectExpr("token", "cid", "n", "case tier when 0 then c0 when 1 then c0 + c1 else c0 + c1 + c2 end - n_shared + nth - 1 as pos")
    )
    rest = (
        sets.filter(F.size("rest") > 0).select("k1", "k2", F.posexplode("rest").alias("at", "token"))
        .join(classes, ["k1", "k2"]).selectExpr("token", "cid", "n", "c0 + c1 + c2 + at as pos").distinct()
    )
    return ahead.unionByName(rest).filter(F.expr(f"pos < n - ceil({percent} * n / 100.0) + 1"))


def _first_members(entries: DataFrame, most: int, large: bool) -> DataFrame:
    """The first `most` members of each bucket, with their `place`. Large buckets are ranked in parts first."""
    if large:
        rows = entries.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(PARTS)))
        entries = rows.withColumn("place", F.expr("row_number() over (partition by token, part order by cid)")).filter(F.col("place") <= most).drop("part", "place")
    return entries.withColumn("place", F.expr("row_number() over (partition by token order by cid)")).filter(F.col("place") <= most)


def _pairs(entries: DataFrame, low: int, high: int, percent: int, large: bool) -> DataFrame:
    """Pairs of entries with members `low` < place <= `high` of their buckets that pass the filters."""
    heads = _first_members(entries, high, large).filter(F.col("place") > low)
    heads = cut_lineage(heads.select("token", *(F.col(c).alias(f"{c}_b") for c in ("cid", "n", "pos", "label", *PARITY))))
    near = (
        f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)"
        f" and {100 + percent} * least(n - pos, n_b - pos_b) >= {percent} * (n + n_b)"
        f" and {100 + percent} * (n + n_b - ({_apart()})) >= 2 * {percent} * (n + n_b)"
    )
    same = (entries["token"] == heads["token"]) & F.expr(f"cid > cid_b and label <> label_b and {near}")
    return entries.join(heads, same).select("cid", "cid_b", "n", "n_b", "label", "label_b").distinct()


def link_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id it links to, at any number of steps)."""
    _, sets, classes, labels = _joined(docs, k, percent)
    return _named(sets, classes, labels)


def link_counts(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`link_components` with n_links: the number of other rows whose document links directly."""
    docs, sets, classes, labels = _joined(docs, k, percent)
    sizes = sets.filter("n > 0").groupBy("k1", "k2").agg(F.count("*").alias("size"))
    classes = cut_lineage(classes.join(sizes, ["k1", "k2"]))
    return _named(sets, classes.join(_class_links(docs, classes, labels, k, percent), "cid", "left"), labels, "coalesce(size - 1 + coalesce(links, 0), 0) as n_links")


def _joined(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents, their sets, the classes of equal sets, and the labels of `_labels`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_describe(k, percent, *_heavy_shingles(docs, k)), _SET).withColumn("row_id", F.monotonically_increasing_id())
    sets = cut_lineage(sets)
    classes = cut_lineage(
        sets.filter("n > 0").groupBy("k1", "k2").agg(
            F.min("row_id").alias("cid"), F.min("doc_id").alias("class_doc"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in PARITY],
            *[F.max(c).alias(c) for c in ("c0", "c1", "c2")],
        )
    )
    sets, classes = _short_names(sets, classes)
    return docs, sets, classes, _labels(docs, sets, classes, k, percent)


def _named(sets: DataFrame, classes: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """One row per document, with `more` expressions on its class."""
    named = classes.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    linked = named.join(labels.select("label").distinct(), "label", "left_semi")
    least = linked.groupBy("label").agg(F.min("class_doc").alias("least_doc"))
    named = named.join(least, "label", "left").withColumn("component_id", F.coalesce("least_doc", "class_doc")).drop("n")
    return sets.select("doc_id", "n", "k1", "k2", "text_key").join(named, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *map(F.expr, more),
    )


def _class_links(docs: DataFrame, classes: DataFrame, labels: DataFrame, k: int, percent: int) -> DataFrame:
    """(cid, links): rows of other classes that link with the class. All pairs within a component of over two classes are compared."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n_classes")).filter("n_classes > 1")
    members = cut_lineage(labels.join(counts, "label").join(classes.select("cid", "class_doc", "k1", "k2", "size"), "cid"))
    two = members.filter("n_classes = 2")
    two = two.join(two.groupBy("label").agg(F.sum("size").alias("both")), "label").selectExpr("cid", "both - size as links")
    many = members.filter("n_classes > 2")
    dealt = many.withColumn("n_blocks", F.ceil(F.col("n_classes") / BLOCK)).withColumn("block", F.expr("pmod(xxhash64(cid), n_blocks)"))
    dealt = dealt.join(_sets_of(docs, many, k), "cid").withColumn("other", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
    met = dealt.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "size", "shingles")
    found = met.groupBy("label", "i", "j").applyInArrow(_count_links(percent), "cid long, links long")
    return cut_lineage(two.unionByName(found.groupBy("cid").agg(F.sum("links").alias("links"))))


def _count_links(percent: int):
    """Sums of the sizes that link, over the pairs between two blocks of classes or within one."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block, size = rows.column("block").to_numpy(), rows.column("size").to_numpy()
        sets = rows.column("shingles").combine_chunks()
        n = sets.value_lengths().to_numpy().astype(np.int64)
        tokens, token = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        ends, owner = np.cumsum(n), np.repeat(np.arange(len(n)), n)
        right = block[owner] == j
        held = owner[right][np.argsort(token[right], kind="stable")]  # classes of block j by shingle
        count = np.bincount(token[right], minlength=len(tokens))
        start = np.cumsum(count) - count
        links = np.zeros(len(n), np.int64)
        for a in np.flatnonzero(block == i):
            own = token[ends[a] - n[a] : ends[a]]
            many = count[own]
            at = np.repeat(start[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(held[at], minlength=len(n))
            linked = (common > 0) & ((100 + percent) * common >= percent * (n[a] + n))
            linked[a] = False
            links[a] += size[linked].sum()
            if i != j:
                links[linked] += size[a]
        return pa.table({"cid": rows.column("cid"), "links": pa.array(links)})

    return run


def let_go(df: DataFrame) -> None:
    """Checkpoints and shuffles that nothing refers to any more are removed from disk now, not at some later garbage collection."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _labels(docs: DataFrame, sets: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(cid, label) of the classes that may link with others; linked classes share a label."""
    entries = cut_lineage(_prefixes(sets, classes, percent).withColumn("label", F.col("cid")))
    let_go(docs)
    whole = labels = failed = None
    low, high = 0, 1
    while True:
        buckets = entries.groupBy("token").agg(F.count("*").alias("size"), F.min("label").alias("a"), F.max("label").alias("b"))
        buckets = cut_lineage(buckets.filter(f"size > {low} and a < b").select("token", "size"))
        large = not buckets.filter(F.col("size") > LARGE).isEmpty()
        entries = cut_lineage(entries.join(bounded(buckets.select("token")), "token", "left_semi"))
        if labels is None:
            live = cut_lineage(entries.select("cid").distinct().join(classes, "cid"))
            labels = live.select("cid", F.col("cid").alias("label"))
            whole = cut_lineage(_sets_of(docs, live, k))
            let_go(docs)
        if entries.isEmpty():
            return labels
        pairs = _pairs(entries.join(bounded(live.select("cid", *PARITY)), "cid"), low, high, percent, large)
        if failed is not None:
            pairs = pairs.join(failed, ["cid", "cid_b"], "left_anti")
        checked = cut_lineage(_checked(cut_lineage(pairs), whole, percent))
        misses = checked.filter("not linked").select("cid", "cid_b")
        failed = misses if failed is None else failed.unionByName(misses)
        new = checked.filter("linked").select(F.col("label").alias("u"), F.col("label_b").alias("v"))
        if not new.isEmpty():
            merged = cut_lineage(components(new).select(F.col("node").alias("label"), F.col("label").alias("joined")))
            labels = labels.join(bounded(merged), "label", "left").select("cid", F.coalesce("joined", "label").alias("label"))
            labels = cut_lineage(labels)
            entries = entries.drop("label").join(bounded(labels), "cid")
        low, high = high, high * REACH
        let_go(docs)


def _checked(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Each pair with whether it links. A set goes once to each of its pairs, and to one place as the other side of all."""
    heads = whole.join(bounded(pairs.select(F.col("cid_b").alias("cid")).distinct()), "cid", "left_semi")
    heads = heads.select(F.col("cid").alias("cid_b"), F.col("shingles").alias("shingles_b"))
    return whole.join(bounded(pairs), "cid").join(heads, "cid_b").selectExpr(
        "cid", "cid_b", "label", "label_b",
        f"{100 + percent} * size(array_intersect(shingles, shingles_b)) >= {percent} * (n + n_b) as linked",
    )


def _sets_of(docs: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """(cid, shingles) of the classes in `live`, computed again from their first documents."""
    ids = live.select(F.col("class_doc").alias("doc_id")).distinct()
    some = docs.join(bounded(ids), "doc_id", "left_semi")
    some = some.unionByName(docs.filter("doc_id is null")) if not live.filter("class_doc is null").isEmpty() else some
    repeated = not some.groupBy("doc_id").count().filter("count > 1").isEmpty()
    sets = some.mapInArrow(_whole_sets(k), "k1 long, k2 long, shingles array<long>")
    sets = sets.join(bounded(live.select("k1", "k2", "cid")), ["k1", "k2"]).select("cid", "shingles")
    return sets.dropDuplicates(["cid"]) if repeated else sets


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows and columns with one document of each component: that of the least doc_id.

    Rows whose doc_id is null are kept. Rows of one doc_id are told apart by their texts; those in a component that
    the doc_id itself names are all kept.
    """
    _, sets, classes, labels = _joined(docs, k, percent)
    found = cut_lineage(_named(sets, classes, labels, "text_key"))
    doc, key = free_names(docs, "gone_id", "gone_key")
    gone = cut_lineage(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct())
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    return docs.join(bounded(gone), same, "left_anti")
