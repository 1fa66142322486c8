"""The corpus queries, each over its whole table with production parameters."""

from __future__ import annotations

from . import decontaminate, exact, html_text, line_dedup, minhash, packing, quality, secrets, suffix_dedup, token_ids
from .common import table

# The pattern of operator 9 for an engine whose case folding goes beyond ASCII.
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def op1_token_ids(spark, sf_dir):
    return token_ids.digest(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))


def op6_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_quality(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    # No other step needs the memory; with a batch more, so many words just fit a dict of 2 ** 21 slots.
    return packing.pack(table(spark, sf_dir, "documents"), cache_words=1_350_000)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_ids, op2_suffix_dedup, op3_minhash_dedup, op4_exact_dedup, op5_line_dedup, op6_html_text,
        op7_quality, op8_decontamination, op9_secret_scan, op10_packing,
    )
}


def _span_sql(kind: int, pattern: str, group: int, least: int, most: int = 1 << 30) -> str:
    """Spans of one kind in the texts ``t``, with starts from the pieces between matches."""
    return f"""
      SELECT doc_id, {kind} AS k, a + b AS s, a + b + length(hits[i]) AS e FROM (
        SELECT doc_id, i, hits, vals, list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT AS a,
               coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)::BIGINT AS b
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals,
                 string_split_regex(t, '{pattern}') AS gaps FROM texts)))
      WHERE length(vals[i]) BETWEEN {least} AND {most}"""


_JOINED = "coalesce(string_agg(['assign', 'access', 'hex', 'secret', 'endpoint'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k), '')"

_SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 base AS ({_span_sql(0, _ASSIGN, 2, secrets.ASSIGN_LEAST)} UNION ALL {_span_sql(1, secrets.ACCESS, 0, 0)} UNION ALL {_span_sql(2, secrets.HEX, 0, 0)}),
 bare AS ({_span_sql(3, secrets.BARE, 0, secrets.BARE_LENGTH, secrets.BARE_LENGTH)} UNION ALL {_span_sql(4, secrets.ENDPOINT.replace("(?::[0-9]+)?", "(:[0-9]+)?"), 0, 0)}),
 weak AS (SELECT * FROM bare w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND b.e > w.s)),
 near AS (SELECT w.*, a.s AS anchor FROM weak w JOIN base a ON a.doc_id = w.doc_id AND a.k = 1 AND w.s < a.e + {secrets.SCOPE} AND w.e > a.s - {secrets.SCOPE}),
 linked AS (SELECT DISTINCT doc_id, k, s, e FROM near n WHERE EXISTS (SELECT 1 FROM near m WHERE m.doc_id = n.doc_id AND m.anchor = n.anchor AND m.k = 3)),
 found AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {_JOINED} AS joined FROM base GROUP BY doc_id),
 whole AS (SELECT doc_id, {_JOINED} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(joined, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (doc_id) LEFT JOIN whole USING (doc_id)"""

_REPEATS = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 y AS (SELECT doc_id, q, length(h) // 2 - 49 AS n, substr(h, (2 * q + 1)::BIGINT, 610) AS piece FROM (SELECT *, unnest(range(0, (length(h) // 2 - 49)::BIGINT, 256)) AS q FROM b)),
 w AS (SELECT doc_id, q + i AS p, substr(piece, (2 * i + 1)::BIGINT, 100) AS x FROM (SELECT *, unnest(range(0, least(256, n - q)::BIGINT)) AS i FROM y)),
 f AS (SELECT x, min(doc_id) AS low FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)),
 g AS (SELECT w.doc_id, w.p FROM w JOIN f ON w.x = f.x WHERE f.low < w.doc_id),
 i AS (SELECT doc_id, p, sum(j) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM
   (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50 THEN 1 ELSE 0 END AS j FROM g)),
 s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, island),
 q AS (SELECT s.*, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
 k AS (SELECT q.doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last,
   string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS kept FROM q JOIN b USING (doc_id) GROUP BY q.doc_id)
SELECT b.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(kept || substr(h, (2 * last + 1)::BIGINT), h))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)"""

_NEAR = """
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM t),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS id, doc_id AS seen FROM t UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.component_id = doc_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(seen) AS component_id FROM r GROUP BY id) m USING (doc_id)"""

# This engine's distance counts bytes: letters beyond ASCII become control characters, which lines do not hold.
_LETTERS = "äöüßÄÖÜéèêëçÉÈÊÇñíóÑÍÓàâîôùáú"
_COUNTED = "etaoinsrhlduc. "
_LINES = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, i AS number, ls[i] AS raw, trim(ls[i], ' ' || chr(9) || chr(13)) AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM t)),
 d AS MATERIALIZED (SELECT line, min(struct_pack(doc_id := doc_id, number := number)) AS first, length(line) AS n,
   translate(line, '{_LETTERS}', {" || ".join(f"chr({k})" for k in range(1, 32) if k not in (9, 10, 13))} || chr(127)) AS a,
   [{", ".join(f"length(line) - length(replace(line, '{c}', ''))" for c in _COUNTED)}] AS c FROM l WHERE line <> '' GROUP BY line),
 p AS (SELECT x.line AS x, y.line AS y, x.first AS fx, y.first AS fy FROM d x JOIN d y ON x.n <= y.n AND y.n <= x.n + x.n // {line_dedup.GROW} AND x.line <> y.line
   WHERE (x.n < y.n OR x.line < y.line) AND list_sum(list_transform(list_zip(x.c, y.c), lambda z: abs(z[1] - z[2]))) <= 2 * (x.n // {line_dedup.GROW})
   AND levenshtein(x.a, y.a) <= x.n // {line_dedup.GROW}),
 k AS (SELECT line, count(*) AS links, min(other) AS earliest FROM (SELECT x AS line, fy AS other FROM p UNION ALL SELECT y, fx FROM p) GROUP BY line),
 m AS (SELECT l.*, l.line <> '' AS counts, l.line <> '' AND struct_pack(doc_id := l.doc_id, number := l.number) = d.first AS own, coalesce(k.links, 0) AS links,
   coalesce(k.earliest < d.first, false) AS near FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN k ON l.line = k.line)
SELECT doc_id, count(*) FILTER (counts) AS n_lines, count(*) FILTER (counts AND NOT own) AS n_repeats, count(*) FILTER (own AND near) AS n_near,
 coalesce(sum(links) FILTER (own), 0)::BIGINT AS n_links, sha256(coalesce(string_agg(raw, chr(10) ORDER BY number) FILTER (NOT counts OR own AND NOT near), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

# The tables' pages have one article of headings and paragraphs, with two references in it.
_ARTICLES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
 b AS (SELECT page_id, url, string_split_regex(regexp_replace(replace(body, '<br>', ' '), '</?b>', '', 'g'), '</?(?:p|h1)>') AS parts FROM a),
 t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts,
   lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t"""

ORACLE_SQL = {
    "op2_suffix_dedup": _REPEATS,
    "op3_minhash_dedup": _NEAR,
    "op4_exact_dedup": """
      WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents),
           g AS (SELECT sha, max(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY sha)
      SELECT t.doc_id, g.keep_id, g.n AS group_size, t.doc_id = g.keep_id AS kept, t.sha AS text_sha256
      FROM t JOIN g ON t.sha = g.sha""",
    "op5_line_dedup": _LINES,
    "op6_html_text": _ARTICLES,
    "op9_secret_scan": _SECRETS,
}
