"""Link graphs, crawl priorities, breadth-first rounds and crawl statistics."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions import url as U
from heronlake.session import cut_lineage


#: Tasks that a host's URLs are dealt to when they are judged by its robots file.
ROBOT_PARTS = 4


def links(pages: DataFrame) -> DataFrame:
    """(page_id, src_url, position, href, dst_url) of pages(page_id, url, html); repeats kept."""
    rows = pages.select("page_id", F.col("url").alias("src_url"), F.posexplode(U.extract_links(F.col("html"))).alias("position", "href"))
    return rows.withColumn("dst_url", U.join_url(F.col("src_url"), F.col("href")))


def edges(pages: DataFrame) -> DataFrame:
    """Distinct links of each page: src and dst URL, first position, domains, and identity of dst."""
    found = links(pages).groupBy("page_id", "src_url", U.normalize(F.col("dst_url")).alias("dst_url")).agg(F.min("position").alias("position"))
    return found.select(
        "*", U.domain(F.col("src_url")).alias("src_domain"), U.domain(F.col("dst_url")).alias("dst_domain"), U.minimize(F.col("dst_url")).alias("min_url")
    )


def domain_counters(links: DataFrame) -> DataFrame:
    """Per target domain: enqueue_count (the first enqueue counts 0) and in_degree (links from other domains)."""
    return links.groupBy(F.col("dst_domain").alias("domain")).agg(
        (F.count("*") - 1).alias("enqueue_count"), F.count_if(F.col("src_domain") != F.col("dst_domain")).alias("in_degree")
    )


def second_last_counts(urls: DataFrame) -> DataFrame:
    return urls.select(U.second_last(U.domain(F.col("url"))).alias("label")).filter("label is not null").groupBy("label").agg(F.count("*").alias("visits"))


def prioritise(candidates: DataFrame, domains: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidates(url) with final_priority from the counters so far (unknown: 0)."""
    rows = candidates.withColumn("domain", U.domain(F.col("url"))).withColumn("label", U.second_last(F.col("domain")))
    rows = rows.join(domains, "domain", "left").join(labels, "label", "left").fillna(0, ["enqueue_count", "in_degree", "visits"])
    parts = U.domain_priority(F.col("enqueue_count")), U.in_degree_priority(F.col("in_degree")), U.second_last_priority(F.col("label"), F.col("visits"))
    return rows.withColumn("final_priority", U.final_priority(*parts))


def frontier_head(frontier: DataFrame, n: int) -> DataFrame:
    """The next n to visit: lowest priority value, then first in."""
    return frontier.orderBy("final_priority", "queue_index").limit(n)


def unseen(links: DataFrame, seen: DataFrame) -> DataFrame:
    """One link for each page identity that `seen`(min_url) lacks."""
    fresh = links.join(seen.select("min_url"), "min_url", "left_anti")
    return fresh.groupBy("min_url").agg(F.min("dst_url").alias("url"))


def page_counters(links: DataFrame, seen: DataFrame, suffix: str) -> DataFrame:
    """Per page: unique, invalid, previously enqueued and new links, and target domains."""
    rows = links.select("page_id", "dst_url", "dst_domain", "min_url", U.is_valid(F.col("dst_url"), suffix).alias("valid"))
    rows = rows.join(seen.select("min_url", F.lit(True).alias("known")).distinct(), "min_url", "left")
    known = F.coalesce("known", F.lit(False))
    return rows.groupBy("page_id").agg(
        F.count("*").alias("n_unique"), F.count_if(~F.col("valid")).alias("n_invalid"), F.count_if(F.col("valid") & known).alias("n_seen"),
        F.count_if(F.col("valid") & ~known).alias("n_new"), F.count_distinct("dst_domain").alias("n_domains"),
    )


def follow_redirects(visited: DataFrame, redirects: DataFrame) -> DataFrame:
    """Identities to mark as seen: those visited and those they were redirected to (url -> final_url)."""
    both = visited.select("url").unionByName(visited.join(redirects, "url").select(F.col("final_url").alias("url")))
    return both.select(U.minimize(F.col("url")).alias("min_url")).distinct()


def redirect_outcomes(visited: DataFrame, redirects: DataFrame, seen: DataFrame, suffix: str = "") -> DataFrame:
    """visited(url) with final_url, its identity, and what becomes of the visit.

    outcome: `direct` (no redirect, or one to the same page), `invalid` (the target is no valid URL), `seen` (its identity is
    in seen(min_url)) or `followed`. Only direct and followed visits count as fetched.
    """
    rows = visited.select("url").join(redirects.select("url", "final_url"), "url", "left")
    rows = rows.withColumn("final_min", U.minimize(F.coalesce("final_url", "url")))
    known = seen.select(F.col("min_url").alias("final_min"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, "final_min", "left")
    same = F.col("final_url").isNull() | (F.col("final_min") == U.minimize(F.col("url")))
    bad = ~U.is_valid(F.col("final_url"), suffix) if suffix else F.lit(False)
    outcome = F.when(same, "direct").when(bad, "invalid").when(F.coalesce("known", F.lit(False)), "seen").otherwise("followed")
    return rows.select("url", "final_url", "final_min", outcome.alias("outcome"))


def breadth_first(
    links: DataFrame, seeds: DataFrame, rounds: int = 3, per_round: int = 200, suffix: str = "", redirects: DataFrame | None = None
) -> DataFrame:
    """Visits in rounds: (min_url, url, depth, visit_order). `links`: as from `edges`; `seeds`: url; `redirects`: url, final_url.

    A round visits the head of the frontier, lowest priority value first, then first in, first out: by the order of the
    visit that found the page, then by the link's place there. A page's priority is that of the round that found it,
    from the counters over all links of all pages visited so far, and is not refreshed. A visit that is redirected marks
    the target as seen and finds the target's links; one redirected to an invalid or seen target finds none.
    """
    first = F.struct(F.lit(-1).cast("long").alias("found_by"), F.lit(0).alias("position"))
    frontier = seeds.groupBy(U.minimize(F.col("url")).alias("min_url")).agg(F.min("url").alias("url"))
    frontier = frontier.select("min_url", "url", F.lit(0).alias("depth"), first.alias("queue_index"), F.lit(0).alias("final_priority"))
    links = links.withColumn("src_min", U.minimize(F.col("src_url")))
    if suffix:
        links = links.filter(U.is_valid(F.col("dst_url"), suffix))
    frontier, done, found, order = cut_lineage(frontier), None, None, ("final_priority", "queue_index", "min_url")
    for depth in range(rounds):
        head = frontier.orderBy(*order).limit(per_round)  # so the windows here hold a bounded number of rows
        head = head.withColumn("visit_order", F.expr(f"row_number() over (order by {', '.join(order)})") + F.lit(depth * per_round).cast("long"))
        head = cut_lineage(head.select("min_url", "url", "depth", "visit_order"))
        waiting = frontier.join(head.select("min_url"), "min_url", "left_anti")
        fetched = head.select(F.col("min_url").alias("src_min"), "visit_order")
        others = None
        if redirects is not None:
            before = head.select("min_url") if done is None else head.select("min_url").unionByName(done.select("min_url"))
            judged = cut_lineage(redirect_outcomes(head, redirects, before, suffix).join(head.select("url", "visit_order"), "url"))
            fetched = judged.filter("outcome in ('direct', 'followed')").select(F.col("final_min").alias("src_min"), "visit_order")
            others = judged.filter("outcome <> 'direct'").select(F.col("final_min").alias("min_url"))
        done = head if done is None else cut_lineage(done.unionByName(head))
        source = links.join(fetched, "src_min")
        found = cut_lineage(source if found is None else found.unionByName(source))
        seen = waiting.select("min_url").unionByName(done.select("min_url"))
        seen = seen if others is None else seen.unionByName(others)
        fresh = found.filter(F.col("visit_order") > depth * per_round).join(seen, "min_url", "left_anti").groupBy("min_url").agg(
            F.min("dst_url").alias("url"), F.min(F.struct(F.col("visit_order").alias("found_by"), "position")).alias("queue_index")
        )
        fresh = prioritise(fresh, domain_counters(found), second_last_counts(done)).withColumn("depth", F.lit(depth + 1))
        frontier = cut_lineage(waiting.unionByName(fresh.select(*waiting.columns)))
        if frontier.isEmpty():
            break
    return done


def totals(visits: DataFrame) -> DataFrame:
    """One row on visits(size, status): pages, successes, bytes, MB and mean KB per success."""
    size, ok = F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("status") == "200")
    return visits.agg(
        F.count("*").alias("total_pages"), ok.alias("successful_pages"), size.alias("total_bytes"), F.round(size / 1048576, 6).alias("total_mb"),
        F.round(F.when(ok > 0, size / ok / 1024).otherwise(F.lit(0.0)), 6).alias("average_kb"),
    )


def status_histogram(visits: DataFrame) -> DataFrame:
    return visits.groupBy("status").agg(F.count("*").alias("n"))


def outcome(status: str = "status", content_type: str = "content_type"):
    """Label of a fetch: a failure by name, `MIME Type Not HTML`, or the status itself."""
    html = F.trim(F.substring_index(F.col(content_type), ";", 1)) == "text/html"
    return F.when(F.col(status).rlike("^[0-9]+$") & ~F.coalesce(html, F.lit(False)), "MIME Type Not HTML").otherwise(F.col(status))


def log_lines(visits: DataFrame) -> DataFrame:
    """Lines of a crawl log for visits(url, size, time, status, depth, order, redirect_url, is_seed)."""
    to = F.when(F.col("redirect_url").isNotNull(), F.concat(F.lit("Redirected to: "), "redirect_url", F.lit(", "))).otherwise("")
    return visits.select("order", F.concat(
        F.format_string("Depth: %d, Status: %s, ", "depth", "status"), F.when(F.col("is_seed"), "(seed)").otherwise(""),
        F.concat(F.lit("URL: "), "url", F.lit(", ")), to, F.format_string("Time: %s, Size: %d bytes", F.col("time").cast("string"), F.col("size")),
    ).alias("line"))


def statistics(visits: DataFrame, frontier: DataFrame) -> DataFrame:
    """`totals` of visits(url, size, status, redirect_url) with redirects, visited domains, and frontier(min_url)'s size."""
    more = visits.agg(F.count("redirect_url").alias("n_redirects"), F.count_distinct(U.domain(F.col("url"))).alias("n_domains"))
    queue = frontier.agg(F.count("*").alias("queue_size"))
    return totals(visits).crossJoin(F.broadcast(more)).crossJoin(F.broadcast(queue))  # one row each


def statistics_lines(report: DataFrame, seconds: float | None = None) -> DataFrame:
    """Lines `name: value` of a one-row report, with the elapsed time where it is given."""
    names = report.columns
    pairs = F.array(*[F.concat(F.lit(f"{n}: "), F.col(n).cast("string")) for n in names])
    lines = report.select(F.posexplode(pairs).alias("nth", "line"))
    if seconds is not None:
        lines = lines.unionByName(report.select(F.lit(len(names)).alias("nth"), F.lit(f"seconds: {seconds:.3f}").alias("line")))
    return lines


def write_log(visits: DataFrame, frontier: DataFrame, folder: str, at: str, seconds: float | None = None) -> str:
    """The log and the statistics as text under `folder`, in a folder named after the time `at`; its path."""
    path = f"{folder}/crawl-{at}"
    log_lines(visits).orderBy("order").select("line").write.text(f"{path}/log")
    statistics_lines(statistics(visits, frontier), seconds).orderBy("nth").select("line").coalesce(1).write.text(f"{path}/statistics")
    return path


def politeness_gaps(visits: DataFrame, key: str, at: str, least: float = 2.0) -> DataFrame:
    """Seconds since the key's last visit, and whether that is under `least`."""
    seconds = F.col(at).cast("timestamp").cast("double")
    rows = visits.withColumn("__s", seconds)
    gap = F.round(F.expr(f"__s - lag(__s) over (partition by {key} order by __s)"), 6)
    return rows.withColumn("gap", gap).drop("__s").withColumn("too_soon", F.coalesce(F.col("gap") < least, F.lit(False)))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls(url) with `allowed` by robots(robots_url, text); a missing file allows."""
    wanted = urls.select("url", U.robots_url(F.col("url")).alias("robots_url"))
    # each URL once and each file once per host: grouped, so that a file's text is not copied to every URL's row

    def judge(asked: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        if not len(files) or files.text.iloc[0] is None:
            return pd.DataFrame({"url": asked.url, "allowed": True})
        rules = RobotFileParser()
        rules.parse(files.text.iloc[0].splitlines())
        return pd.DataFrame({"url": asked.url, "allowed": [rules.can_fetch(agent, u) for u in asked.url]})

    dealt = wanted.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(ROBOT_PARTS)))  # a hot host's URLs go to several tasks
    files = robots.select("robots_url", "text").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ROBOT_PARTS - 1).cast("long"))))
    return dealt.groupBy("robots_url", "part").cogroup(files.groupBy("robots_url", "part")).applyInPandas(judge, "url string, allowed boolean")


def sample_seeds(seeds: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n seeds (all, if fewer), the first by MD5 of seed and URL."""
    return seeds.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("url"))), "url").limit(n)
