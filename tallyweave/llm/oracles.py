"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

from . import license_scan

_LINES = """
lines AS (
  SELECT doc_id, n, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS unit
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
)"""

OP2 = f"""
WITH {_LINES},
units AS (SELECT doc_id, n, unit, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS s FROM lines WHERE unit <> ''),
runs AS (
  SELECT doc_id, s, unit || chr(10) || lead(unit, 1) OVER w || chr(10) || lead(unit, 2) OVER w AS run
  FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY s)
),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM runs WHERE run IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT u.doc_id, u.n FROM units u JOIN later l ON u.doc_id = l.doc_id AND u.s BETWEEN l.s AND l.s + 2),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.n) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n WHERE g.n IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(u.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM units GROUP BY doc_id) u ON d.doc_id = u.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id
LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP6 = """
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS n FROM split),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS s, ws FROM split WHERE len(ws) >= 35),
windows AS (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 34), ' ')) AS w FROM starts),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY w) AS c FROM windows) WHERE c > 1),
marks AS (SELECT w.doc_id, w.n, w.word, max(a.s) OVER (PARTITION BY w.doc_id ORDER BY w.n) AS last FROM words w LEFT JOIN again a ON w.doc_id = a.doc_id AND w.n = a.s),
sums AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE last >= n - 34) AS n_removed,
         string_agg(word, ' ' ORDER BY n) FILTER (WHERE last IS NULL OR last < n - 34) AS kept
  FROM marks GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""

ORACLES = {"op1_license_scan": license_scan.oracle(), "op2_line_dedup": OP2, "op6_substring_dedup": OP6}
