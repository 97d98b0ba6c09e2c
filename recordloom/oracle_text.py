"""SQL of the normalizer, for an engine whose patterns have no lookahead and no back references: token by token."""

from __future__ import annotations

from recordloom.functions import lexicon as lex
from recordloom.functions.text import SPOKEN_SKELETONS


def skeleton_sql(x: str) -> str:
    """The skeleton rewrites, with repeats collapsed letter by letter."""
    for a, b in lex.SKELETON_REWRITES:
        a, b = (a.replace("(?=[eiy])", "([eiy])"), "s\\1") if "(?=" in a else (a, b.replace("$1", "\\1"))
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    x = f"translate({x}, '{lex.SKELETON_FROM}', '{lex.SKELETON_TO}')"
    for c in "bcdfghjklmnpqrstvwxz0123456789":
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


def ascii_sql(x: str) -> str:
    """Lower case and Latin letters, for texts of Latin letters with accents and sharp s."""
    for a, b in (("ß", "s"), ("‘", "''"), ("’", "''")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace(strip_accents(lower({x})), '[^\\x00-\\x7F]', ' ', 'g')"


def list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def map_sql(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


def names_sql() -> str:
    s = ascii_sql("raw")
    for p in (r"https?://|www\.", r"\.(?:com|c0m|co\.in|net|org|in|fr|co|biz|info|io|us)\b", r"\b(?:f/k/a|a/k/a|d/b/a|fka|aka|dba|formerly)\b"):
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    s = f"regexp_replace(translate(replace(replace({s}, '&', ' and '), '+', ' plus '), '.`''', ''), '[^a-z0-9]+', ' ', 'g')"
    return f"""
WITH n AS (
  SELECT 'part' AS source, p_name AS raw FROM part UNION ALL SELECT 'customer', c_name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier
  UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'pages', url FROM pages
), u AS (SELECT source, raw, count(*) AS n, [x FOR x IN string_split({s}, ' ') IF x <> ''] AS w FROM n GROUP BY source, raw
), t AS (
  SELECT source, raw, i, CASE WHEN regexp_matches(w[i], '[0-9]') AND regexp_matches(w[i], '[a-z]') THEN translate(w[i], '{lex.OCR_DIGITS}', '{lex.OCR_LETTERS}') ELSE w[i] END AS t
  FROM (SELECT source, raw, w, unnest(range(1, len(w) + 1)) AS i FROM u)
), k AS (SELECT *, {skeleton_sql("t")} AS k FROM t
), g AS (SELECT *, list_contains({list_sql(lex.LEGAL_WORDS)}, t) AS listed, CASE WHEN length(t) >= 5 THEN {map_sql(SPOKEN_SKELETONS)}[k] END AS said FROM k
), a AS (
  SELECT source, raw, string_agg(DISTINCT c, ' ' ORDER BY c) AS legal
  FROM (SELECT source, raw, CASE WHEN listed THEN {map_sql(lex.LEGAL_CLASSES)}[t] ELSE said END AS c FROM g) WHERE c IS NOT NULL GROUP BY ALL
), b AS (
  SELECT * FROM (SELECT *, lag(t) OVER (PARTITION BY source, raw ORDER BY i) AS p FROM g WHERE NOT listed AND said IS NULL) WHERE p IS NULL OR p <> t
), c AS (SELECT source, raw, string_agg(t, ' ' ORDER BY i) AS name, string_agg(CASE WHEN k = '' THEN substr(t, 1, 1) ELSE k END, ' ' ORDER BY i) AS skel FROM b GROUP BY ALL)
SELECT source, raw, n, coalesce(name, '') AS name, coalesce(legal, '') AS legal, coalesce(skel, '') AS skel FROM u LEFT JOIN a USING (source, raw) LEFT JOIN c USING (source, raw)
"""


def addresses_sql() -> str:
    s = f"replace({ascii_sql('raw')}, '<null>', ' ')"
    us = s
    for n in sorted(lex.US_STATES, key=len, reverse=True):
        us = f"regexp_replace({us}, '\\b{n}\\b', '{lex.US_STATES[n]}', 'g')"
    codes = list_sql(sorted(set(lex.US_STATES.values())))
    return f"""
WITH d AS (
  SELECT page_id AS id, url AS raw, 'US' AS country FROM pages UNION ALL SELECT doc_id, text, CASE WHEN lang = 'fr' THEN 'France' ELSE upper(lang) END FROM documents
), r AS (SELECT row_number() OVER () AS rid, id, country, CASE WHEN country = 'US' THEN {us} ELSE {s} END AS s FROM d
), u AS (SELECT rid, country, [x FOR x IN string_split(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'), ' ') IF x <> ''] AS w FROM r
), t AS (SELECT rid, country, i, w[i] AS t FROM (SELECT rid, country, w, unnest(range(1, len(w) + 1)) AS i FROM u)
), l AS (
  SELECT rid, i, CASE WHEN regexp_matches(t, '^[0-9]+[a-z]?$|^[a-z]?[0-9]+$') THEN [t] ELSE regexp_extract_all(t, '[0-9]+') END AS l FROM t WHERE regexp_matches(t, '[0-9]')
), n AS (SELECT rid, i, j, regexp_replace(x, '^0+(.)', '\\1') AS x FROM (SELECT rid, i, unnest(l) AS x, generate_subscripts(l, 1) AS j FROM l)
), nums AS (SELECT rid, string_agg(x, ' ' ORDER BY i, j) AS nums FROM (SELECT *, row_number() OVER (PARTITION BY rid, x ORDER BY i, j) AS k FROM n) WHERE k = 1 GROUP BY rid
), p AS (SELECT *, country = 'US' AND list_contains({codes}, t) AS code FROM t WHERE NOT regexp_matches(t, '[0-9]')
), st AS (SELECT rid, arg_max(t, i) AS state FROM p WHERE code GROUP BY rid
), e AS (SELECT rid, i, coalesce(CASE WHEN country = 'France' THEN {map_sql(lex.FRENCH_WORDS)}[t] END, {map_sql(lex.ADDRESS_WORDS)}[t], t) AS t FROM p WHERE NOT code
), a AS (
  SELECT rid, string_agg(t, ' ' ORDER BY i) AS addr FROM e
  WHERE t <> '' AND NOT list_contains({list_sql(lex.ADDRESS_DROPS)}, t) AND (length(t) > 1 OR t IN ('n', 's', 'e', 'w')) GROUP BY rid
)
SELECT id, country, coalesce(addr, '') AS addr, coalesce(nums, '') AS nums, coalesce(state, '') AS state
FROM r LEFT JOIN a USING (rid) LEFT JOIN nums USING (rid) LEFT JOIN st USING (rid)
"""
