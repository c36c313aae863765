"""SQL twins, in DuckDB's dialect, of the queries in `catalog`."""

from __future__ import annotations

from heronlake.functions import text as T
from heronlake.functions.url import AUTHORITY, BLACKLIST, BY_ENQUEUED, BY_IN_DEGREE, BY_KNOWN_LABEL, BY_OTHER_LABEL, LINKS, PATH, WEIGHTS, WHITELIST

#: Characters U+00A0 to U+00FF by what their second UTF-8 byte does: the first byte always separates.
_HIGH = set(T.INDEX_HIGH_BYTES)
_SECOND = {chr(c): chr(c).encode()[1] in _HIGH for c in range(0xA0, 0x100)}
_SEPARATING = "".join(c for c, s in _SECOND.items() if s)
_CUTTING = "".join(c for c, s in _SECOND.items() if not s)
_MARKS = r"\s\x0b!-/:-@\[-`{-~"


def tokens(column: str) -> str:
    """Tokens of a text: a cutting character leaves a byte that starts no token."""
    lower = f"translate(coalesce({column}, ''), '{T.UPPER}', '{T.LOWER}')"
    cut = f"regexp_replace({lower}, '[{_CUTTING}]', ' ' || chr(1), 'g')"
    return f"list_filter(string_split_regex({cut}, '[{_SEPARATING}{_MARKS}]'), lambda t: regexp_matches(t, '^[a-z0-9]'))"


#: Of U+00C0 to U+00FF, what ends a token of a case-keeping query after its first byte; all of U+00A0 to U+00BF end one before it.
_QUERY_HIGH = set(T.QUERY_HIGH_BYTES)
_ENDING = "".join(c for c in map(chr, range(0xC0, 0x100)) if c.encode()[1] in _QUERY_HIGH)
_BETWEEN = "".join(c for c in map(chr, range(0xA0, 0xC0)) if c.encode()[1] in _QUERY_HIGH)


def cased_tokens(column: str) -> str:
    """Tokens of a case-keeping query: bytes outside ASCII that stay in a token keep it from matching."""
    ended = f"regexp_replace(coalesce({column}, ''), '[{_ENDING}]', chr(1) || ' ', 'g')"
    cut = f"regexp_replace(regexp_replace({ended}, '[{_BETWEEN}]', ' ', 'g'), '[\u00a0-\u00bf]', ' ' || chr(1), 'g')"
    return f"list_filter(string_split_regex({cut}, '[{_MARKS}]'), lambda t: t <> '')"


_TOKENS = f"toks AS (SELECT doc_id, text, {tokens('text')} AS ts FROM documents)"
_POSTINGS = f"{_TOKENS}, postings AS (SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM toks) GROUP BY doc_id, term)"
_STATS = "stats AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS INTEGER) AS data_length, CAST(len(list_distinct(ts)) AS INTEGER) AS word_count FROM toks)"
POSTINGS = f"WITH {_POSTINGS} "
TF = POSTINGS + "SELECT term, doc_id, tf FROM postings"
STATS = f"WITH {_TOKENS}, {_STATS} "
_LEXICON = "lexicon AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"


def _part(length: str, average: str) -> str:
    return f"ln((n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (1.2 * (0.25 + 0.75 * {length} / {average}) + tf)"


def bm25(mode: str = "or", length: str = "word_count", average: str | None = None, content: bool = False, k: int = 20, asked: str = tokens("text")) -> str:
    average = average or f"avg({length})"
    need = "HAVING count(*) = any_value(n_terms)" if mode == "and" else ""
    head = f"""WITH {_POSTINGS}, {_STATS}, {_LEXICON},
corpus AS (SELECT count(*) AS n, {average} AS mean FROM stats),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({asked}) AS term FROM benchmark) GROUP BY query_id, term),
qn AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms FROM q),
scored AS (SELECT query_id, doc_id, round(sum(qtf * {_part(length, 'mean')}), 9) AS score
  FROM qn JOIN postings USING (term) JOIN lexicon USING (term) JOIN stats USING (doc_id), corpus GROUP BY query_id, doc_id {need}),
ranked AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored),
hits AS (SELECT * FROM ranked WHERE rank <= {k}) """
    if content:
        return head + "SELECT query_id, doc_id, rank, 'DocId: ' || doc_id || ', Score: 0.000000, Content: ' || replace(text, ',', ' ') AS line FROM hits JOIN documents USING (doc_id)"
    return head + "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM hits"


def max_impact() -> str:
    return f"""WITH {_POSTINGS}, {_STATS}, {_LEXICON}, corpus AS (SELECT count(*) AS n, avg(word_count) AS mean FROM stats)
SELECT term, round(max({_part('word_count', 'mean')}), 6) AS max_impact FROM postings JOIN lexicon USING (term) JOIN stats USING (doc_id), corpus GROUP BY term"""


CHUNKS = f"""WITH {_POSTINGS}, c AS (SELECT term, doc_id, tf, CAST((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 64 AS INTEGER) AS chunk FROM postings),
chunks AS (SELECT *, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, chunk ORDER BY doc_id), 0) AS delta FROM c) """


def varbyte(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {1 << (7 * k)} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"


METADATA = CHUNKS.rstrip() + f""", metadata AS (SELECT term, chunk, max(doc_id) AS last_doc_id, count(*) AS n_postings,
CAST(sum({varbyte('delta')}) AS BIGINT) AS id_bytes, CAST(sum({varbyte('tf')}) AS BIGINT) AS tf_bytes FROM chunks GROUP BY term, chunk) """

L2 = "list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def vector_topk(score: str, wrap: str = "{}", k: int = 20) -> str:
    return f"""WITH {_V}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, {wrap.format(score)} AS score FROM v q, v c WHERE q.vec_id % 100 = 0),
run AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM run WHERE rank <= {k}"""


_RUN = f"""{_V}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_inner_product(q.v, c.v), 9) AS score FROM v q, v c WHERE q.vec_id % 100 = 0),
run AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 50)"""
_QRELS = "qrels AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, CAST(2 - c.vec_id % 2 AS INTEGER) AS rel FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 100 = 0)"
VECTOR_RUN = f"WITH {_RUN} "
QRELS = f"WITH {_QRELS} "

METRICS = f"""WITH {_RUN}, {_QRELS},
j AS (SELECT query_id, doc_id, coalesce(rel, 0) AS rel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS r FROM run LEFT JOIN qrels USING (query_id, doc_id)),
h AS (SELECT *, sum(CAST(rel >= 1 AS INTEGER)) OVER (PARTITION BY query_id ORDER BY r) AS hits FROM j),
i AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM qrels),
n AS (SELECT query_id, count(*) AS n_rel, sum(rel / log2(r + 1)) FILTER (r <= 10) AS ideal FROM i GROUP BY query_id),
metrics AS (SELECT query_id, round(count(*) FILTER (rel >= 1 AND r <= 10) / 10, 6) AS p_10, round(count(*) FILTER (rel >= 1 AND r <= 30) / any_value(n_rel), 6) AS recall_30,
  round(coalesce(sum(hits / r) FILTER (rel >= 1), 0) / any_value(n_rel), 6) AS map, round(coalesce(sum(rel / log2(r + 1)) FILTER (r <= 10), 0) / any_value(ideal), 6) AS ndcg_10,
  round(coalesce(1 / min(r) FILTER (rel >= 1), 0), 6) AS recip_rank FROM h JOIN n USING (query_id) GROUP BY query_id) """

MRR = f"""WITH {_RUN}, {_QRELS}, f AS (SELECT query_id, min(rank) FILTER (rel = 1) AS r FROM run LEFT JOIN qrels USING (query_id, doc_id) GROUP BY query_id)
SELECT round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM f"""

RERANK = bm25(k=100) .rsplit("SELECT query_id, doc_id, rank, round(score, 6) AS score FROM hits", 1)[0] + """, s AS (
SELECT query_id, doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
FROM hits JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id),
r AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20"""

OVERLAP = bm25(k=50).rsplit("SELECT query_id, doc_id, rank, round(score, 6) AS score FROM hits", 1)[0] + f""", qt AS (SELECT item_id AS query_id, list_distinct({tokens('text')}) AS qs FROM benchmark),
s AS (SELECT query_id, doc_id, round(CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ts)) / len(qs) ELSE 0 END, 9) AS score FROM hits JOIN qt USING (query_id) JOIN toks USING (doc_id)),
r AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def domain(url: str) -> str:
    return f"regexp_extract({url}, {_quoted(AUTHORITY)}, 1)"


def second_last(host: str) -> str:
    return f"CASE WHEN len(string_split({host}, '.')) >= 2 THEN string_split({host}, '.')[-2] END"


def minimized(url: str) -> str:
    return f"'//' || replace(lower({domain(url)}), 'www.', '') || regexp_replace(regexp_extract({url}, {_quoted(PATH)}, 1), '/+$', '')"


def valid(url: str, suffix: str) -> str:
    endings = "|".join(e.replace(".", r"\.") for e in BLACKLIST)
    return f"ends_with({domain(url)}, '{suffix}') AND NOT regexp_matches(lower({url}), '({endings})$')"


# the test pages' links all start with one slash and hold no dot segments
_LINKS = f"""raw AS (SELECT page_id, url, regexp_extract_all(html, {_quoted(LINKS)}, 1) AS hs FROM pages),
links AS (SELECT page_id, url AS src_url, CAST(i - 1 AS INTEGER) AS position, hs[i] AS href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || trim(hs[i]) AS dst_url
  FROM (SELECT page_id, url, hs, unnest(range(1, len(hs) + 1)) AS i FROM raw))"""
LINKS = f"WITH {_LINKS} "
_EDGES = f"""{_LINKS}, edges AS (SELECT page_id, src_url, dst_url, position, {domain('src_url')} AS src_domain, {domain('dst_url')} AS dst_domain, {minimized('dst_url')} AS min_url
  FROM (SELECT page_id, src_url, regexp_replace(dst_url, '[?#].*$', '', 's') AS dst_url, min(position) AS position FROM links GROUP BY ALL))"""
EDGES = f"WITH {_EDGES} "
_DOMAINS = "domains AS (SELECT dst_domain AS domain, count(*) - 1 AS enqueue_count, count(*) FILTER (src_domain <> dst_domain) AS in_degree FROM edges GROUP BY dst_domain)"
DOMAINS = f"WITH {_EDGES}, {_DOMAINS} "
_UNSEEN = f"seen AS (SELECT DISTINCT {minimized('url')} AS min_url FROM pages), unseen AS (SELECT min_url, min(dst_url) AS url FROM edges WHERE min_url NOT IN (SELECT min_url FROM seen) GROUP BY min_url)"
UNSEEN = f"WITH {_EDGES}, {_UNSEEN} "


def _grades(value: str, scale: tuple) -> str:
    bounds, last = scale
    return "CASE " + " ".join(f"WHEN {value} <= {most} THEN {grade}" for most, grade in bounds) + f" ELSE {last} END"


_KNOWN, _OTHER = _grades("visits", BY_KNOWN_LABEL), _grades("visits", BY_OTHER_LABEL)


def final_priority(e: str, i: str, label: str) -> str:
    """From links enqueued, in-degree and label, and `visits` of the label."""
    own = f"CASE WHEN {label} IS NULL THEN 10 WHEN {label} IN ({', '.join(f"'{w}'" for w in WHITELIST)}) THEN {_KNOWN} ELSE {_OTHER} END"
    return f"CAST({WEIGHTS[0]} * ({_grades(e, BY_ENQUEUED)}) + {WEIGHTS[1]} * ({_grades(i, BY_IN_DEGREE)}) + {WEIGHTS[2]} * ({own}) AS INTEGER)"


PRIORITIES = f"""WITH {_EDGES}, {_DOMAINS}, {_UNSEEN}, labels2 AS (SELECT {second_last(domain('url'))} AS label, count(*) AS visits FROM pages GROUP BY 1),
c AS (SELECT min_url, {domain('url')} AS domain, {second_last(domain('url'))} AS label FROM unseen),
f AS (SELECT min_url, label, coalesce(enqueue_count, 0) AS e, coalesce(in_degree, 0) AS i, coalesce(visits, 0) AS visits FROM c LEFT JOIN domains USING (domain) LEFT JOIN labels2 USING (label)),
priorities AS (SELECT min_url, {final_priority('e', 'i', 'label')} AS final_priority FROM f) """

PAGE_COUNTERS = f"""WITH {_EDGES}, {_UNSEEN}, v AS (SELECT *, {valid('dst_url', '.org')} AS valid, min_url IN (SELECT min_url FROM seen) AS known FROM edges)
SELECT page_id, count(*) AS n_unique, count(*) FILTER (NOT valid) AS n_invalid, count(*) FILTER (valid AND known) AS n_seen, count(*) FILTER (valid AND NOT known) AS n_new,
count(DISTINCT dst_domain) AS n_domains FROM v GROUP BY page_id"""

VISITS = "WITH visits AS (SELECT event_id, user_id, ts, CAST(floor(abs(value) * 1000) AS BIGINT) AS size, CASE WHEN event_type = 'click' THEN '200' ELSE event_type END AS status FROM events) "

SCALES = f"""SELECT doc_id, {_grades('n_chars', BY_ENQUEUED)} AS by_domain, {_grades('n_chars', BY_IN_DEGREE)} AS by_in_degree,
{_KNOWN} AS by_known, CASE WHEN lang IS NULL THEN 10 ELSE {_OTHER} END AS by_label FROM (SELECT doc_id, lang, n_chars, n_chars AS visits FROM documents)"""

# a visit's time is the latest of its own wish and two seconds after each wish before it
_WISHES = """v AS (SELECT 'https://www.u' || user_id || '.org/' || event_type || '?e=' || event_id AS url, 'www.u' || user_id || '.org' AS domain, epoch(ts) AS t FROM events)"""
SCHEDULE = f"""WITH {_WISHES},
n AS (SELECT *, 2 * row_number() OVER (PARTITION BY domain ORDER BY t, url) AS ahead FROM v)
SELECT url, domain, round(t, 3) AS wanted_at, round(ahead + max(t - ahead) OVER (PARTITION BY domain ORDER BY ahead), 3) AS visit_at FROM n"""


def schedule_with_timeouts(least: float, give_up: float) -> str:
    """One visit after the other: a late one is not made and keeps none waiting."""
    return f"""WITH RECURSIVE {_WISHES}, n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY t, url) AS i FROM v),
r AS (SELECT url, domain, t, i, t AS visit_at, t AS last FROM n WHERE i = 1
  UNION ALL SELECT n.url, n.domain, n.t, n.i, CASE WHEN greatest(n.t, last + {least}) - n.t > {give_up} THEN NULL ELSE greatest(n.t, last + {least}) END,
    CASE WHEN greatest(n.t, last + {least}) - n.t > {give_up} THEN last ELSE greatest(n.t, last + {least}) END FROM r JOIN n ON n.domain = r.domain AND n.i = r.i + 1)
SELECT url, round(t, 3) AS wanted_at, round(visit_at, 3) AS visit_at, CASE WHEN visit_at IS NULL THEN 'Timeout' END AS outcome FROM r"""


def blocks(capacity: int) -> str:
    """Chunks fill blocks one after the other."""
    return METADATA.replace("WITH", "WITH RECURSIVE", 1) + f""", z AS (SELECT term, chunk, id_bytes + tf_bytes + 12 AS size FROM metadata),
f AS (SELECT term, chunk, size AS used, CAST(1 AS BIGINT) AS n FROM z WHERE chunk = 0
  UNION ALL SELECT z.term, z.chunk, CASE WHEN used > 0 AND used + size > {capacity} THEN size ELSE used + size END, CASE WHEN used > 0 AND used + size > {capacity} THEN n + 1 ELSE n END
  FROM f JOIN z ON z.term = f.term AND z.chunk = f.chunk + 1)
SELECT term, max(n) AS n_blocks FROM f GROUP BY term"""


def hashed(dim: int, tables: int, bits: int, probes: int, k: int) -> str:
    """CTEs up to `run`: top k among the vectors whose bucket differs from the query's in few bits, in any table; exact where there are too few."""
    steps = "r0 AS (SELECT i, i + 1 AS x FROM range(%d) t(i))" % (tables * bits * dim)
    for n in (1, 2, 3):
        steps += f", s{n} AS (SELECT i, (x * 1664525 + 1013904223) % 4294967296 AS x FROM r{n - 1}), r{n} AS (SELECT i, xor(x, x >> 15) AS x FROM s{n})"
    return f"""WITH {_V}, {steps},
planes AS (SELECT i // {dim} AS p, list(x / 2147483648.0 - 1 ORDER BY i) AS w FROM r3 GROUP BY 1),
hashes AS (SELECT vec_id, p // {bits} AS t, CAST(sum(CASE WHEN list_inner_product(v, w::DOUBLE[]) > 0 THEN 1 << (p % {bits}) ELSE 0 END) AS BIGINT) AS b FROM v, planes GROUP BY 1, 2),
near AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id AS doc_id FROM hashes q JOIN hashes c ON q.t = c.t AND bit_count(xor(q.b, c.b)) <= {probes} WHERE q.vec_id % 100 = 0),
pairs AS (SELECT * FROM near UNION SELECT q.vec_id, c.vec_id FROM v q, v c WHERE q.vec_id % 100 = 0 AND (SELECT count(*) FROM near n WHERE n.query_id = q.vec_id) < {k}),
s AS (SELECT query_id, doc_id, round(list_inner_product(q.v, c.v), 9) AS score FROM pairs JOIN v q ON q.vec_id = query_id JOIN v c ON c.vec_id = doc_id),
run AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}) """


def negatives(qrels: str, asked: str, docs: str, ratio: int = 10) -> str:
    """CTEs up to `positives` and `negatives`. The sources give query_id, doc_id and rel; query_id; doc_id."""
    return f"""WITH qrels AS ({qrels}), q AS ({asked}), docs AS ({docs}),
judged AS (SELECT query_id, doc_id, rel FROM qrels WHERE query_id IN (SELECT query_id FROM q)),
wanted AS (SELECT query_id, {ratio} * count(*) FILTER (rel = 1) AS n, count(*) AS n_judged FROM judged GROUP BY query_id HAVING n > 0),
places AS (SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) - 1 AS place FROM docs),
walks AS (SELECT query_id, n, step, (CAST('0x' || substr(md5('q1:' || query_id), 1, 12) AS BIGINT) + step) % n_docs AS place
  FROM (SELECT *, unnest(range(0, least(n_docs, n + n_judged))) AS step FROM wanted, (SELECT count(*) AS n_docs FROM docs))),
pairs AS (SELECT query_id, doc_id, n, row_number() OVER (PARTITION BY query_id ORDER BY step) AS taken FROM walks JOIN places USING (place)
  WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM judged)),
positives AS (SELECT query_id, doc_id, CAST(1 AS INTEGER) AS label FROM judged WHERE rel = 1 AND doc_id IN (SELECT doc_id FROM docs)),
negatives AS (SELECT query_id, doc_id, CAST(0 AS INTEGER) AS label FROM pairs WHERE taken <= n) """


VECTOR_NEGATIVES = negatives(
    QRELS + "SELECT query_id, doc_id, rel FROM qrels", "SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0", "SELECT vec_id AS doc_id FROM embeddings"
)
TEXT_NEGATIVES = negatives(
    "SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id, quality AS rel FROM labels", "SELECT item_id AS query_id FROM benchmark", "SELECT doc_id FROM documents"
)
ENCODED = """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower('passage: ' || coalesce(text, '')), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM w),
d AS (SELECT doc_id, CAST(h % 64 AS INTEGER) AS dim, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS s FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS norm FROM d GROUP BY 1)
SELECT doc_id, dim, round(s / norm, 6) AS value FROM d JOIN n USING (doc_id) WHERE s <> 0"""


def breadth_first(rounds: int, per_round: int, n_seeds: int) -> str:
    """The rounds written out one after the other."""
    order = "final_priority, found_by, position, min_url"
    sql = f"""WITH {_EDGES}, e AS (SELECT *, {minimized('src_url')} AS src_min FROM edges),
f0 AS (SELECT {minimized('url')} AS min_url, min(url) AS url, 0 AS depth, CAST(-1 AS BIGINT) AS found_by, 0 AS position, 0 AS final_priority
  FROM (SELECT url FROM pages ORDER BY md5('1:' || url), url LIMIT {n_seeds}) GROUP BY 1)"""
    done = ""
    for i in range(rounds):
        sql += f""",
h{i} AS (SELECT min_url, url, depth, row_number() OVER (ORDER BY {order}) + {i * per_round} AS visit_order FROM (SELECT * FROM f{i} ORDER BY {order} LIMIT {per_round})),
d{i} AS (SELECT * FROM h{i}{done}),
w{i} AS (SELECT * FROM f{i} WHERE min_url NOT IN (SELECT min_url FROM h{i})),
a{i} AS (SELECT e.*, d.visit_order FROM e JOIN d{i} d ON e.src_min = d.min_url),
n{i} AS (SELECT min_url, min(dst_url) AS url, min((visit_order, position)) AS p FROM a{i} WHERE visit_order > {i * per_round}
  AND min_url NOT IN (SELECT min_url FROM w{i} UNION SELECT min_url FROM d{i}) GROUP BY min_url),
c{i} AS (SELECT dst_domain AS domain, count(*) - 1 AS e, count(*) FILTER (src_domain <> dst_domain) AS i FROM a{i} GROUP BY 1),
l{i} AS (SELECT {second_last(domain('url'))} AS label, count(*) AS visits FROM d{i} GROUP BY 1),
p{i} AS (SELECT min_url, url, p, coalesce(e, 0) AS e, coalesce(i, 0) AS i, label, coalesce(visits, 0) AS visits
  FROM (SELECT *, {domain('url')} AS domain, {second_last(domain('url'))} AS label FROM n{i}) LEFT JOIN c{i} USING (domain) LEFT JOIN l{i} USING (label)),
f{i + 1} AS (SELECT * FROM w{i} UNION ALL SELECT min_url, url, {i + 1}, p[1], p[2], {final_priority('e', 'i', 'label')} FROM p{i})"""
        done = f" UNION ALL SELECT * FROM d{i}"
    return sql + f" SELECT min_url, url, depth, visit_order FROM d{rounds - 1}"
