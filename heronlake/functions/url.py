"""URL scalars as Column expressions; urljoin's dot segments included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of URLs that are not visited.
BLACKLIST = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".txt", ".zip", ".rar", ".tar", ".gz", ".7z", ".bz2",
    ".mp3", ".wav", ".ogg", ".aac", ".flac", ".mp4", ".avi", ".mov", ".mkv", ".webm", ".exe", ".bin", ".dll", ".msi", ".sh", ".iso", ".css", ".js", ".json", ".xml", ".rss",
    ".ico", ".ttf", ".woff", ".woff2", ".eot", ".swf", ".flv", ".fla", ".php", ".aspx", ".cgi", ".py", ".pl", ".rb", ".jsp", ".dat", ".log", ".bak",
)
# Second-level labels with their own priority scale.
WHITELIST = ("govt", "org", "ac", "co", "cri", "health", "com", "net", "edu", "mil", "info", "biz", "int", "ai", "io", "tech", "xyz")
# The grades of the three priority scales, as (largest value, grade), and the grade beyond.
BY_ENQUEUED = ((0, 1), (1, 2), (2, 3), (5, 4), (10, 5), (100, 6), (1000, 7), (10_000, 8), (1_000_000, 9)), 10
BY_IN_DEGREE = ((0, 10), (1, 9), (2, 8), (5, 7), (10, 6), (20, 5), (50, 4), (500, 3), (8000, 2)), 1
BY_KNOWN_LABEL = ((0, 1), (5, 2), (20, 3), (50, 4), (200, 5), (500, 6), (1000, 7), (10_000, 8), (100_000, 9)), 10
BY_OTHER_LABEL = ((0, 2), (3, 3), (6, 4), (15, 5), (50, 6), (600, 8), (10_000, 9)), 10
# The weights of enqueued links, of in-degree and of the label.
WEIGHTS = 47, 13, 29
# Fixed values end.

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
LINKS = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)"""


def domain(url: Column) -> Column:
    """Authority with port and case kept; empty where there is none."""
    return F.regexp_extract(url, AUTHORITY, 1)


def second_last(host: Column) -> Column:
    """The second label from the right; null if there is one label only."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2)))


def normalize(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#][\s\S]*$", "")


def minimize(url: Column) -> Column:
    """The identity of a page: no scheme, query or fragment; host lower-cased without `www.`; no closing slashes."""
    host = F.replace(F.lower(domain(url)), F.lit("www."), F.lit(""))
    return F.concat(F.lit("//"), host, F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+$", ""))


def is_valid(url: Column, suffix: str = ".nz") -> Column:
    """Host ends with `suffix` (as written, port included) and the URL has no blacklisted ending."""
    endings = "|".join(e.replace(".", r"\.") for e in BLACKLIST)
    return F.endswith(domain(url), F.lit(suffix)) & ~F.lower(url).rlike(f"({endings})$")


def robots_url(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/robots.txt"))


def extract_links(html: Column) -> Column:
    """All href values of anchors, in order."""
    return F.regexp_extract_all(html, F.lit(LINKS), F.lit(1))


def _without_dots(path: Column) -> Column:
    """RFC 3986 removal of dot segments from an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(part == "..", up).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    kept = F.aggregate(parts, empty, step)
    closing = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.array_join(kept, "/"), closing)).otherwise(path)


def join_url(base: Column, href: Column) -> Column:
    """`href` resolved against `base`: absolute, `//host`, `/path`, `?query`, `#fragment`, relative and empty forms."""
    ref = F.trim(href)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), domain(base))
    path = F.regexp_extract(base, PATH, 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    ref_path, ref_rest = F.regexp_extract(ref, "^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*([\s\S]*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(root, _without_dots(ref_path), ref_rest))
        .when(ref == "", base)
        .when(F.startswith(ref, F.lit("?")), F.concat(root, path, ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(root, path, query, ref))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, ref_path)), ref_rest))
    )


def _grade(value: Column, scale: tuple) -> Column:
    bounds, last = scale
    out = F.lit(last)
    for most, grade in reversed(bounds):
        out = F.when(value <= most, grade).otherwise(out)
    return out


def domain_priority(enqueued: Column) -> Column:
    return _grade(enqueued, BY_ENQUEUED)


def in_degree_priority(in_degree: Column) -> Column:
    return _grade(in_degree, BY_IN_DEGREE)


def second_last_priority(label: Column, visits: Column) -> Column:
    return F.when(label.isNull(), 10).when(label.isin(*WHITELIST), _grade(visits, BY_KNOWN_LABEL)).otherwise(_grade(visits, BY_OTHER_LABEL))


def final_priority(by_domain: Column, by_in_degree: Column, by_second_last: Column) -> Column:
    """Lower comes first."""
    return WEIGHTS[0] * by_domain + WEIGHTS[1] * by_in_degree + WEIGHTS[2] * by_second_last
