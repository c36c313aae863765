"""Crawl state on streams: exactly-once URLs, per-domain politeness, counts over event time."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heronlake.functions import url as U
from heronlake.session import shared_folder

#: Rows of one domain that a task sorts at once; beyond, sorted runs are spilled and merged by pieces of so many rows.
RUN, PIECE = 200_000, 2000


def first_visits(visits: DataFrame, at: str = "ts", delay: str | None = None) -> DataFrame:
    """Visits(url, ts) whose page identity is new. Identities are remembered for ever, or for `delay` of event time where it is given."""
    rows = visits.withColumn("min_url", U.minimize(F.col("url")))
    if delay is None:
        return rows.dropDuplicates(["min_url"])
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["min_url"])


def _in_order(batches: Iterator[pd.DataFrame], run: int) -> Iterator[pd.DataFrame]:
    """The rows (url, domain, wanted_at) of all batches by time and URL, as one order over several frames."""
    parts: list[pd.DataFrame] = []
    runs: list[list[int]] = []
    by_time = lambda: pd.concat(parts, ignore_index=True).sort_values(["wanted_at", "url"])
    with tempfile.TemporaryFile() as spilled:

        def spill() -> None:
            rows, places = by_time(), []
            for at in range(0, len(rows), PIECE):
                places.append(spilled.seek(0, 2))
                pickle.dump(rows.iloc[at : at + PIECE], spilled)
            runs.append(places)
            parts.clear()

        def read(places: list[int]) -> Iterator[tuple]:
            for at in places:
                spilled.seek(at)
                yield from pickle.load(spilled).itertuples(index=False, name=None)

        for batch in batches:
            parts.append(batch[["url", "domain", "wanted_at"]])
            if sum(map(len, parts)) >= run:
                spill()
        if not runs:
            if parts:
                yield by_time()
            return
        if parts:
            spill()
        # as in sort_values, missing times and URLs come last
        merged = heapq.merge(*map(read, runs), key=lambda r: (r[2] != r[2], r[2] if r[2] == r[2] else 0.0, r[0] is None, r[0] or ""))
        while rows := list(islice(merged, PIECE)):
            yield pd.DataFrame(rows, columns=["url", "domain", "wanted_at"])


def schedule(visits: DataFrame, least: float = 2.0, delay: str = "1 hour", give_up: float | None = None) -> DataFrame:
    """(url, domain, wanted_at, visit_at, outcome): each domain's visits, `least` seconds apart.

    A visit that would have to wait for more than `give_up` seconds is not made: its visit_at is null, its outcome
    `Timeout`, and it keeps no other one waiting. Without `give_up` every visit is made; the outcome is null then.

    A domain's visits of one trigger are placed in the order of (wanted_at, url), over all batches they come in.
    State: the domain's last visit, until the watermark (`delay` behind the latest visit) has passed it by an hour.
    """
    marked = visits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = marked.select("url", U.domain(F.col("url")).alias("domain"), "ts", F.col("ts").cast("double").alias("wanted_at"))

    run = RUN

    def place(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        for batch in _in_order(batches, run):
            out = []
            for t in batch.wanted_at:
                at = max(t, last + least)
                late = give_up is not None and at - t > give_up
                out.append(None if late else at)
                last = last if late else at
            found = batch.assign(visit_at=pd.Series(out, index=batch.index, dtype="float64"))
            found["outcome"] = pd.Series([None if x is not None else "Timeout" for x in out], index=batch.index, dtype=object)
            yield found[["url", "domain", "wanted_at", "visit_at", "outcome"]]
        state.update((last,))
        state.setTimeoutTimestamp(max(int(max(last, 0.0) * 1000), state.getCurrentWatermarkMs()) + 3_600_000)

    return rows.groupBy("domain").applyInPandasWithState(
        place, "url string, domain string, wanted_at double, visit_at double, outcome string", "last double", "append", GroupStateTimeout.EventTimeTimeout
    )


def windowed_counts(events: DataFrame, at: str = "ts", size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window (an extension: batch or stream)."""
    rows = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", delay)
    counts = rows.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def drain(stream: DataFrame) -> DataFrame:
    """All that a stream gives on the input there is now, by way of a table in the shared folder."""
    spark = stream.sparkSession
    out = shared_folder(spark, "stream")
    run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
