"""The queries in DuckDB SQL."""

from __future__ import annotations

from ..functions import text as T

_q = lambda words: ", ".join("'" + w + "'" for w in words)
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ADDRESS_WORDS.items()) + "}"


def latin(x: str) -> str:
    out = f"translate(lower(coalesce({x}, '')), '{T._ACCENTED}', '{T._BARE}')"
    for letter, spelling in T.PLAIN_SPELLING.items():
        out = f"replace({out}, '{letter}', '{spelling}')"
    return f"trim(regexp_replace(replace({out}, '&', ' and '), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def ordered(x: str) -> str:
    """Distinct elements of a list in their first order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def salient(x: str) -> str:
    told = f"list_filter(list_distinct({tokens(x)}), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_q(T.LEGAL)}))"
    return f"list_transform(list_sort(list_transform({told}, lambda t: {{'n': -length(t), 't': t}})), lambda s: s.t)"


RECORDS = f"""
base AS (SELECT doc_id, lang, {latin('text')} AS norm FROM documents),
records AS (
  SELECT doc_id AS row_id, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, (doc_id % 3)::INT AS role,
         array_to_string(list_slice(string_split(norm, ' '), 1, 5), ' ') AS business_name,
         array_to_string(list_slice(string_split(norm, ' '), 6, 13), ' ') AS business_address,
         coalesce(lang, '') AS country, md5(norm) AS mark
  FROM base
),
named AS (SELECT *, {latin('business_name')} AS name, {latin('business_address')} AS raw, {latin('country')} AS nation FROM records),
shaped AS (
  SELECT *, array_to_string(list_filter({tokens('name')}, lambda t: t NOT IN ({_q(T.LEGAL)})), ' ') AS core,
         array_to_string(list_transform({tokens('raw')}, lambda t: coalesce({_MAP}[t], t)), ' ') AS address
  FROM named
),
prepared AS (
  SELECT *, list_distinct({tokens('core')}) AS core_set, list_distinct({tokens('address')}) AS address_set, list_distinct({tokens('name')}) AS name_set,
         regexp_extract_all(address, '[0-9]+') AS runs, {salient('core')} AS told, {tokens('core')} AS core_tokens, {tokens('address')} AS place,
         list_slice(list_filter({tokens('address')}, lambda t: regexp_matches(t, '[0-9]')), 1, 2) AS numbers,
         list_filter({tokens('address')}, lambda t: length(t) >= 3 AND NOT regexp_matches(t, '[0-9]') AND t NOT IN ({_q(T.ADDRESS_COMMON)})) AS words
  FROM shaped
)"""

_FIVE = "list_sort(list_slice(told, 1, 5))"
KEYS = f"""{RECORDS},
kinds AS (
  SELECT row_id, role, nation, unnest([
    {{'k': 'n', 'v': [core]}}, {{'k': 'ns', 'v': [array_to_string(list_sort(core_tokens), ' ')]}},
    {{'k': 'a', 'v': [address]}}, {{'k': 'as', 'v': [array_to_string(list_sort(place), ' ')]}},
    {{'k': 'h', 'v': flatten(list_transform(numbers, lambda n: list_transform(list_slice(words, 1, 4), lambda w: n || ' ' || w)))}},
    {{'k': 't', 'v': list_slice(told, 1, 5)}},
    {{'k': 'p', 'v': list_slice(flatten(list_transform({_FIVE}, lambda x, i: list_transform(list_slice({_FIVE}, i + 1, 5), lambda y: x || ' ' || y))), 1, 6)}},
    {{'k': 'f', 'v': list_transform(list_filter(list_slice(told, 1, 3), lambda t: length(t) >= 5), lambda t: substr(t, 1, 5))}},
    {{'k': 'w', 'v': list_slice(words, 1, 2)}}]) AS kind
  FROM prepared
),
keys AS (SELECT DISTINCT row_id, role, nation || '|' || k || '|' || v AS key FROM (SELECT row_id, role, nation, kind.k AS k, unnest(kind.v) AS v FROM kinds) WHERE v <> '')"""

PAIRS = f"""{KEYS},
good AS (SELECT key, count(*) AS postings FROM keys WHERE role > 0 AND key IN (SELECT key FROM keys WHERE role = 0) GROUP BY key HAVING count(*) <= 150),
pairs AS (SELECT DISTINCT q.row_id AS query_id, t.row_id FROM keys q JOIN good USING (key) JOIN keys t USING (key) WHERE q.role = 0 AND t.role > 0)"""


def _overlap(x: str, y: str) -> tuple[str, str]:
    both = f"len(list_intersect({x}, {y}))"
    return f"({both} / greatest(1, len(list_distinct(list_concat({x}, {y})))))", f"({both} / greatest(1, least(len({x}), len({y}))))"


_N, _P = _overlap("l.core_set", "r.core_set"), _overlap("l.address_set", "r.address_set")
SCORED = f"""{PAIRS},
truth AS (SELECT q.row_id AS query_id, t.row_id FROM records q JOIN records t ON q.country = t.country AND q.mark = t.mark WHERE q.role = 0 AND t.role > 0),
scored AS (
  SELECT query_id, p.row_id, round(0.6 * {_N[0]} + 0.4 * {_P[0]}, 6) AS p, round(0.5 * {_N[1]} + 0.5 * {_P[1]}, 6) AS p2
  FROM pairs p JOIN prepared l ON l.row_id = p.query_id JOIN prepared r ON r.row_id = p.row_id
),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, row_id DESC) AS rank FROM scored) WHERE rank <= 32),
marked AS (SELECT t.*, h.row_id IS NOT NULL AS match FROM top t LEFT JOIN truth h ON t.query_id = h.query_id AND t.row_id = h.row_id)"""


def per_query(threshold: str, source: str = "marked") -> str:
    return f"""
queries AS (SELECT row_id AS query_id, entity_id, country FROM records WHERE role = 0),
counts AS (SELECT query_id, count(*) FILTER (WHERE p::FLOAT >= {threshold}::FLOAT) AS n_predicted,
  count(*) FILTER (WHERE p::FLOAT >= {threshold}::FLOAT AND match) AS n_hits, count(*) FILTER (WHERE match) AS n_found FROM {source} GROUP BY query_id),
true_counts AS (SELECT query_id, count(*) AS n_true FROM truth GROUP BY query_id),
per_query AS (
  SELECT query_id, country, coalesce(n_true, 0) AS n_true, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_hits, 0) AS n_hits, coalesce(n_found, 0) AS n_found,
    CASE WHEN 0.25 * coalesce(n_true, 0) + coalesce(n_predicted, 0) > 0 THEN 1.25 * coalesce(n_hits, 0) / (0.25 * coalesce(n_true, 0) + coalesce(n_predicted, 0)) ELSE 1.0 END::DOUBLE AS f05
  FROM queries LEFT JOIN true_counts USING (query_id) LEFT JOIN counts USING (query_id)
)"""


REPORT = """round(avg(f05), 6) AS macro_f05,
  round(CASE WHEN sum(n_predicted) > 0 THEN sum(n_hits) / sum(n_predicted) ELSE 0 END::DOUBLE, 6) AS micro_precision,
  round(CASE WHEN sum(n_true) > 0 THEN sum(n_hits) / sum(n_true) ELSE 0 END::DOUBLE, 6) AS micro_recall,
  round(CASE WHEN sum(n_true) > 0 THEN sum(n_found) / sum(n_true) ELSE 1 END::DOUBLE, 6) AS candidate_recall,
  round(avg(CASE WHEN n_true = 0 THEN (n_predicted = 0)::INT::DOUBLE END), 6) AS singleton_accuracy,
  count(*) AS queries, sum(n_true)::BIGINT AS true_links, sum(n_predicted)::BIGINT AS predicted_links, sum(n_hits)::BIGINT AS true_positive_links,
  count(*) FILTER (WHERE n_true = 0) AS singleton_queries"""


def curve(thresholds: list[float], weights: tuple[float, ...]) -> str:
    grid = lambda xs: "unnest([" + ", ".join(f"{x}::DOUBLE" for x in xs) + "])"
    return f"""
points AS (SELECT weight, threshold FROM (SELECT {grid(weights)} AS weight) CROSS JOIN (SELECT {grid(thresholds)} AS threshold)),
over_counts AS (
  SELECT query_id, weight, threshold, count(*) AS n_predicted, count(*) FILTER (WHERE match) AS n_hits
  FROM marked CROSS JOIN points WHERE ((1 - weight) * p + weight * p2)::FLOAT >= threshold::FLOAT GROUP BY ALL
),
true_counts AS (SELECT query_id, count(*) AS n_true FROM truth GROUP BY query_id),
curve AS (
  SELECT weight, threshold, avg(CASE WHEN 0.25 * coalesce(n_true, 0) + coalesce(n_predicted, 0) > 0
    THEN 1.25 * coalesce(n_hits, 0) / (0.25 * coalesce(n_true, 0) + coalesce(n_predicted, 0)) ELSE 1.0 END::DOUBLE) AS macro_f05
  FROM (SELECT row_id AS query_id FROM records WHERE role = 0) CROSS JOIN points LEFT JOIN true_counts USING (query_id) LEFT JOIN over_counts USING (query_id, weight, threshold)
  GROUP BY weight, threshold
)"""


def lcs(pairs: str, key: str) -> str:
    """CTEs that give (key, lcs) of pairs(key, a, b), strings under 60 characters: a row of the table as bits."""
    return f"""
steps AS (
  SELECT {key}, a, b, 0 AS n, ((1::HUGEINT << length(a)::INT) - 1) AS row FROM {pairs}
  UNION ALL
  SELECT {key}, a, b, n + 1, ((row + (row & hit)) | (row - (row & hit))) & ((1::HUGEINT << length(a)::INT) - 1)
  FROM (
    SELECT *, coalesce(list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN substr(a, i, 1) = substr(b, n + 1, 1) THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)), 0)::HUGEINT AS hit
    FROM steps WHERE n < length(b)
  )
),
lcs AS (SELECT {key}, a, b, length(a) - bit_count(row) AS lcs FROM steps WHERE n = length(b))"""


# --- string measures over distinct pairs of strings, the shorter one under 127 characters ------------


def masked(strings: str, name: str) -> str:
    """CTE name(a, b, s, l, masks): the shorter and the longer string, and for each character of the longer one
    the bits of its places in the shorter one."""
    mask = "list_sum(list_transform(range(length(s)), lambda i: CASE WHEN substr(s, i + 1, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT"
    return f"""
{name}_s AS (SELECT DISTINCT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM {strings} WHERE a <> '' AND b <> ''),
{name} AS (SELECT a, b, s, l, list_transform(range(length(l)), lambda j: substr(l, j + 1, 1)) AS chars,
  list_transform(list_transform(range(length(l)), lambda j: substr(l, j + 1, 1)), lambda c: {mask}) AS masks FROM {name}_s)"""


def lcs_of(masks: str, size: str) -> str:
    """Length of the longest common subsequence of a string of that size and the characters with these masks."""
    full = f"((1::HUGEINT << ({size})::INT) - 1)"
    step = f"lambda row, hit: ((row + (row & hit)) | (row - (row & hit))) & {full}"
    return f"(({size}) - bit_count(list_reduce(list_prepend({full}, {masks}), {step})))"


def ratios(strings: str, name: str) -> str:
    """CTE name(a, b, r) of strings(a, b)."""
    return f"""{masked(strings, name + '_m')},
{name} AS (SELECT a, b, 2 * {lcs_of('masks', 'length(s)')} / (length(s) + length(l))::DOUBLE AS r FROM {name}_m)"""


def set_ratios(strings: str, name: str) -> str:
    """CTE name(a, b, r): the token set ratio."""
    joined = lambda x: f"array_to_string(list_sort({x}), ' ')"
    without = lambda x, y: f"list_filter({x}, lambda t: NOT list_contains({y}, t))"
    return f"""
{name}_t AS (SELECT DISTINCT a AS p, b AS q, list_distinct({tokens('a')}) AS x, list_distinct({tokens('b')}) AS y FROM {strings}),
{name}_u AS (SELECT *, {joined('list_intersect(x, y)')} AS common, {joined(without('x', 'y'))} AS left_only, {joined(without('y', 'x'))} AS right_only FROM {name}_t),
{name}_v AS (SELECT *, CASE WHEN common = '' THEN left_only ELSE common || ' ' || left_only END AS a, CASE WHEN common = '' THEN right_only ELSE common || ' ' || right_only END AS b FROM {name}_u),
{ratios(f"{name}_v", name + '_r')},
{name} AS (
  SELECT p AS a, q AS b, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN common <> '' AND (left_only = '' OR right_only = '') THEN 1.0
    WHEN common = '' THEN coalesce(r, 0.0)
    ELSE greatest(coalesce(r, 0.0), 2 * length(common) / (length(common) + length(v.a))::DOUBLE, 2 * length(common) / (length(common) + length(v.b))::DOUBLE) END AS r
  FROM {name}_v v LEFT JOIN {name}_r z ON v.a = z.a AND v.b = z.b
)"""


def partials(strings: str, name: str) -> str:
    """CTE name(a, b, r): the best ratio with a window of the longer string; equal lengths are tried both ways."""
    windows = """list_concat(list_concat(
    list_transform(range(length(l) - length(s) + 1), lambda i: {'f': i + 1, 't': i + length(s)}),
    list_transform(range(1, length(s)), lambda e: {'f': 1::BIGINT, 't': e})),
    list_transform(range(length(l) - length(s) + 1, length(l)), lambda i: {'f': i + 1, 't': length(l)}))"""
    return f"""
{name}_p AS (SELECT DISTINCT a, b FROM {strings} UNION SELECT DISTINCT b, a FROM {strings} WHERE length(a) = length(b)),
{masked(name + '_p', name + '_m')},
{name}_b AS (SELECT a, b, s, l, masks FROM {name}_m UNION ALL
  SELECT b, a, s, l, masks FROM {name}_m WHERE length(a) = length(b) AND a <> b),
{name}_w AS (SELECT a, b, s, masks, unnest({windows}) AS w FROM {name}_b),
{name} AS (SELECT a, b, max(2 * {lcs_of('list_slice(masks, w.f, w.t)', 'length(s)')} / (length(s) + w.t - w.f + 1)::DOUBLE) AS r FROM {name}_w GROUP BY a, b)"""


def fuzzy(sets: str, name: str) -> str:
    """CTE name(key, r) of sets(key, x, y): the mean over the smaller token set of each token's best ratio."""
    return f"""
{name}_k AS (SELECT key, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS short, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS long FROM {sets}),
{name}_t AS (SELECT key, short, long, unnest(short) AS a FROM {name}_k),
{name}_c AS (SELECT key, a, unnest(long) AS b FROM {name}_t),
{ratios(f"(SELECT DISTINCT a, b FROM {name}_c)", name + '_r')},
{name}_e AS (SELECT c.key, c.a, max(r) AS best FROM {name}_c c JOIN {name}_r z ON c.a = z.a AND c.b = z.b GROUP BY c.key, c.a),
{name} AS (SELECT k.key, coalesce(sum(best), 0.0) / greatest(1, any_value(len(short))) AS r FROM {name}_k k LEFT JOIN {name}_e e ON k.key = e.key GROUP BY k.key)"""
