"""Language identification by Bayesian evidence fusion.

Evidence per document: the text (byte-trigram likelihoods, tempered for the trigrams'
overlap), the language declared in markup (how often documents of each language declare
it), the address suffix and the host (priors). The model of text is fitted on a bounded
sample of labelled rows. All priors and declaration rates are grouped sums of the text
posteriors over all documents: a host's prior is smoothed towards its suffix's, that
towards the corpus's. The class `und` has uniform text likelihood; documents it wins, and
documents without a language of at least `least` posterior, are rejected.

Defined cases: null and empty texts, and texts without trigrams of letters, have no text evidence and
are rejected, whatever their other evidence. A missing host, suffix or declaration adds no
evidence of its own (null hosts share one prior). Null labels aren't fitted on. Repeated
rows get equal results. Texts of any length are scored whole, in blocks. Without labelled
rows, and on an empty table, nothing is accepted. Columns other than those named are ignored
by `identify` and kept by `drop_unidentified`, whatever their names are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm import worker
from heronlake.llm.sides import bounded, free_names
from heronlake.session import cut_lineage

#: Labelled rows that the text model is fitted on, at most.
FIT_ROWS = 5000
#: Trigrams are hashed to so many bits.
BITS = 16
#: Rows' worth of a parent's prior in a child's; tempering of text; prior of `und`.
SMOOTHING, TEMPER, OPEN = 20.0, 1 / 3, 0.01
#: Bytes of text scored at once.
BLOCK = 1 << 21

#: Letters in lower case and bytes of other scripts stand for themselves, all else for a space.
_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def _codes(data: bytes) -> np.ndarray:
    """Hashed trigrams with two letters at least: digits and signs say nothing about the language."""
    b = _LETTERS[np.frombuffer(data, np.uint8)]
    letter = (b > 32).astype(np.int8)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (x[letter[:-2] + letter[1:-1] + letter[2:] >= 2] * np.uint32(2654435761)) >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class TextModel:
    """Log likelihoods of hashed byte trigrams, one row per language."""

    languages: tuple[str, ...]
    table: np.ndarray

    def scores(self, text: bytes) -> np.ndarray | None:
        """Log likelihoods of the languages and of `und`; None without trigrams of letters."""
        if len(text) < 3 or not self.languages:
            return None
        total, n = np.zeros(len(self.languages) + 1), 0
        for at in range(0, len(text) - 2, BLOCK):
            codes = _codes(text[at : at + BLOCK + 2])
            total[:-1] += self.table[:, codes].sum(axis=1, dtype=np.float64)
            n += len(codes)
        total[-1] = -n * BITS * math.log(2)
        return total if n else None


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.forget("language_id")
    counts: dict[str, np.ndarray] = {}
    for batch in worker.slices(batches):
        for label, text in zip(batch.column("label").to_pylist(), worker.texts(batch), strict=True):
            into = counts.setdefault(label, np.zeros(1 << BITS, np.int64))
            for at in range(0, len(text) - 2, BLOCK):
                into += np.bincount(_codes(text[at : at + BLOCK + 2]), minlength=1 << BITS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["label", "counts"]
    )


def fit_text_model(labelled: DataFrame, label: str = "lang", rows: int = FIT_ROWS) -> TextModel:
    """Fit on at most `rows` labelled rows, chosen by hash; languages with text only."""
    known = labelled.filter(F.col(label).isNotNull() & F.col("text").isNotNull())
    n = max(known.count(), 1)
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < math.ceil(1_000_000 * 0.9 * rows / n)
    sample = known.filter(share).select(F.col(label).cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    found = sample.limit(rows).mapInArrow(_gram_counts, "label string, counts binary").collect()  # one row per language
    counts = {r.label: np.frombuffer(bytes(r.counts), np.int64) for r in found}
    languages = tuple(sorted(k for k, c in counts.items() if c.sum()))
    table = [np.log((counts[k] + 0.1) / (counts[k].sum() + 0.1 * (1 << BITS))) for k in languages]
    return TextModel(languages, np.array(table, np.float32).reshape(len(languages), 1 << BITS))


def _score(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget("language_id")
        for batch in worker.slices(batches):
            scores = [model.scores(t) for t in worker.texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "text_key", "host", "suffix", "declared")], pa.array([None if s is None else TEMPER * s for s in scores], pa.list_(pa.float64()))],
                ["doc_id", "text_key", "host", "suffix", "declared", "scores"],
            )
        worker.give_back()

    return run


def _softmax(logs: Column) -> Column:
    most = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - most))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


def identify(
    docs: DataFrame, model: TextModel, doc_id: str = "doc_id", host: Column | None = None, suffix: Column | None = None,
    declared: Column | None = None, least: float = 0.5,
) -> DataFrame:
    """One row per document: doc_id, text_key (xxhash64 of the text), lang (null if rejected), posterior, accepted."""
    missing = F.lit(None).cast("string")
    host, suffix, declared = (missing if c is None else c for c in (host, suffix, declared))
    short = F.lower(F.substring(declared, 1, 2))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), host.alias("host"), suffix.alias("suffix"),
        F.when(short.isin(*model.languages), short).when(short.isNotNull(), F.lit("other")).alias("declared"),
        F.col("text").cast("string").alias("text"),
    )
    schema = "doc_id long, text_key long, host string, suffix string, declared string, scores array<double>"
    scored = cut_lineage(rows.mapInArrow(_score(model), schema))
    n = len(model.languages)
    if not n:
        return scored.select("doc_id", "text_key", missing.alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"))
    flat = [F.lit(math.log((1 - OPEN) / n))] * n + [F.lit(math.log(OPEN))]
    alone = scored.filter("scores is not null").withColumn("p", _softmax(F.zip_with("scores", F.array(*flat), lambda a, b: a + b)))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    hosts = cut_lineage(alone.groupBy("host", "suffix").agg(*sums))
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    top = hosts.agg(*again).first()
    whole = [(top[i] or 0.0) + 1.0 for i in range(n)]
    overall = F.array(*[F.lit(x / sum(whole)) for x in whole])
    below = lambda own, parent: F.zip_with(own, parent, lambda a, b: a + SMOOTHING * b)
    norm = lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda s, y: s + y))
    counts = F.array(*[F.col(f"s{i}") for i in range(n)])
    suffixes = hosts.groupBy("suffix").agg(*again).select(F.col("suffix").alias("x"), norm(below(counts, overall)).alias("suffix_prior"))
    priors = hosts.join(suffixes, hosts["suffix"].eqNullSafe(F.col("x"))).select(
        F.col("host").alias("h"), F.col("suffix").alias("x"), norm(below(counts, F.col("suffix_prior"))).alias("prior")
    )
    priors = cut_lineage(priors)
    rates = alone.filter("declared is not null").groupBy("declared").agg(*sums)  # at most one row per language, and one
    table = {r.declared: [r[f"s{i}"] for i in range(n)] for r in rates.collect()}
    columns = [sum(v[i] for v in table.values()) + n + 1 for i in range(n)]
    declared_logs = F.lit(None).cast("array<double>")
    for name, v in table.items():
        declared_logs = F.when(F.col("declared") == name, F.array(*[F.lit(math.log((v[i] + 1) / columns[i])) for i in range(n)])).otherwise(declared_logs)
    neutral = F.array(*[F.lit(0.0)] * n)
    fused = scored.join(
        bounded(priors), scored["host"].eqNullSafe(priors["h"]) & scored["suffix"].eqNullSafe(priors["x"]), "left"
    )
    prior = F.transform(F.coalesce("prior", overall), lambda p: F.log(p * (1 - OPEN)))
    told = F.zip_with(prior, F.coalesce(declared_logs, neutral), lambda a, b: a + b)
    # a declaration says nothing about `und`: it gets the mean rate
    logs = F.zip_with("scores", F.concat(told, F.array(F.lit(math.log(OPEN)))), lambda a, b: a + b)
    fused = fused.withColumn("p", _softmax(logs)).withColumn("posterior", F.array_max("p"))
    best = F.array_position("p", F.col("posterior")).cast("int")
    lang = F.try_element_at(F.array(*map(F.lit, model.languages)), best)
    accepted = F.coalesce(lang.isNotNull() & (F.col("posterior") >= least), F.lit(False))
    return fused.select("doc_id", "text_key", F.when(accepted, lang).alias("lang"), "posterior", accepted.alias("accepted"))


def page_evidence(pages: DataFrame) -> dict[str, Column]:
    """Host, suffix and declared language of rows with url and html, as arguments of `identify`."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    declared = F.regexp_extract("html", r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z-]+)""", 1)
    return {"host": host, "suffix": F.element_at(F.split(host, r"\."), -1), "declared": F.when(declared != "", declared)}


def page_texts(pages: DataFrame) -> Column:
    """The text of rows with html: without scripts, styles and tags."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def drop_unidentified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The input's rows and columns without documents that `identify` rejects; `source` is the host."""
    found = cut_lineage(identify(docs, fit_text_model(docs), host=F.col("source").cast("string"), least=least))
    doc, key = free_names(docs, "gone_id", "gone_key")
    gone = cut_lineage(found.filter("not accepted").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))
    return docs.join(bounded(gone), same, "left_anti")
