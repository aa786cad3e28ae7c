"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, u.pos AS pos, lines[u.pos] AS line,
         translate(trim(lines[u.pos], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM docs, unnest(range(1, len(lines) + 1)) AS u(pos)),
frequent AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, pos, line, f.key IS NOT NULL AND doc_id <> f.top AS gone
  FROM lines LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# base32 of the 160 bits of SHA-1: 32 groups of five bits
WARC = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY sha1(body)) AS first
  FROM rows),
bits AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''),
    lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS b FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
    + CAST(substr(b, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""

# conversations with the last answer of their neighbour as the rejected version
PREFERENCE_PAIRS = """
WITH last AS (
  SELECT conv_id, max(turn) AS ends, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
rejected AS (
  SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c LEFT JOIN last l USING (conv_id)
  WHERE l.ends IS NULL OR c.turn < l.ends
  UNION ALL
  SELECT a.conv_id, a.ends, 'assistant', b.answer FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1)),
versions AS (
  SELECT c.conv_id, c.turns AS c, coalesce(r.turns, []) AS r
  FROM (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY 1) c
  LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM rejected GROUP BY 1) r
  USING (conv_id)),
cut AS (
  SELECT *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])[1] - 1,
                     least(len(c), len(r))) AS k FROM versions),
parts AS (SELECT conv_id, k, c[1:k] AS p, c[k + 1:] AS c, r[k + 1:] AS r FROM cut)
SELECT conv_id, CAST(k AS BIGINT) AS prompt_turns,
  array_to_string(list_transform(p, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS prompt,
  array_to_string(list_transform(c, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS chosen,
  array_to_string(list_transform(c, lambda t: '0:' || (13 + length(t.role)) || ',' || CAST(t.role = 'assistant' AS INT) || ':'
    || (11 + length(t.text))), ',') AS chosen_mask,
  array_to_string(list_transform(r, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS rejected,
  array_to_string(list_transform(r, lambda t: '0:' || (13 + length(t.role)) || ',' || CAST(t.role = 'assistant' AS INT) || ':'
    || (11 + length(t.text))), ',') AS rejected_mask
FROM parts
"""

# documents in reach of each other by four-word shingles; recursion over the links finds components
JACCARD = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) ON doc_id = a
"""

_TERMS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LEXICAL_SEARCH = f"""
WITH tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n) AS words FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""


def _url_level(level: int) -> str:
    """One level of the path tree: frequent segments with labels, merged with neighbours in order of their share."""
    at = level + 1
    return f"""
kids{at} AS (
  SELECT host, template, segments[{at}] AS seg, sum(pages) AS pages, sum(labels) AS labels, sum(bad) AS bad
  FROM tree{level} WHERE len(segments) >= {at} GROUP BY ALL),
shares{at} AS (
  SELECT k.*, CAST(bad AS DOUBLE) / labels AS share FROM kids{at} k
  JOIN (SELECT host, template, sum(pages) AS total FROM kids{at} GROUP BY ALL) USING (host, template)
  WHERE labels >= 5 AND pages * 20 >= total),
steps{at} AS (
  SELECT *, share - lag(share) OVER o AS gap, CAST(bad + lag(bad) OVER o AS DOUBLE) / (labels + lag(labels) OVER o) AS pooled,
    1.0::DOUBLE / labels + 1.0::DOUBLE / lag(labels) OVER o AS spread
  FROM shares{at} WINDOW o AS (PARTITION BY host, template ORDER BY share, seg)),
groups{at} AS (
  SELECT *, sum(CASE WHEN gap > 1.96::DOUBLE * sqrt(pooled * (1 - pooled) * spread) THEN 1 ELSE 0 END)
    OVER (PARTITION BY host, template ORDER BY share, seg) AS grp FROM steps{at}),
branches{at} AS (
  SELECT host, template, seg, array_to_string(list_sort(list(seg) OVER (PARTITION BY host, template, grp)), '|') AS branch FROM groups{at}),
tree{at} AS (
  SELECT t.* EXCLUDE (template), t.template || CASE WHEN len(segments) >= {at} THEN '/' || coalesce(branch, '*') ELSE '' END AS template
  FROM tree{level} t LEFT JOIN branches{at} b ON t.host = b.host AND t.template = b.template AND t.segments[{at}] = b.seg),"""


URL_FILTER = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
placed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
known AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
tree0 AS (
  SELECT host, path, count(*) AS pages, count(bad) AS labels, coalesce(sum(bad), 0) AS bad,
    string_split(path, '/')[2:] AS segments, '' AS template
  FROM placed LEFT JOIN known ON page_id = doc_id GROUP BY host, path),{"".join(_url_level(i) for i in range(4))}
named AS (SELECT *, template || CASE WHEN len(segments) > 4 THEN '/**' ELSE '' END AS tmpl FROM tree4),
own AS (SELECT host, tmpl, sum(labels) AS labels, sum(bad) AS bad FROM named GROUP BY ALL),
hosts AS (SELECT host, sum(labels) AS host_labels, sum(bad) AS host_bad FROM own GROUP BY host),
overall AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(labels), 0) + 3.0::DOUBLE) AS rate FROM own),
judged AS (
  SELECT host, tmpl, (bad + 4.0::DOUBLE * ((host_bad + 4.0::DOUBLE * rate) / (host_labels + 4.0::DOUBLE))) / (labels + 4.0::DOUBLE) AS bad_share
  FROM own JOIN hosts USING (host), overall),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM placed)
SELECT page_id, r.host AS host, r.path AS path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN bad_share >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, n.tmpl AS template, bad_share
FROM ruled r JOIN named n ON r.host = n.host AND r.path = n.path JOIN judged j ON n.host = j.host AND n.tmpl = j.tmpl
"""

SQL = {
    "op3_warc": WARC,
    "op4_preference_pairs": PREFERENCE_PAIRS,
    "op8_jaccard_join": JACCARD,
    "op9_line_dedup": LINE_DEDUP,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op13_url_filter": URL_FILTER,
}
