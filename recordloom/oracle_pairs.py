"""SQL of string similarities, key channels and pair features, for the queries that work on parts as records."""

from __future__ import annotations

#: Parts as normalized records (k is the number), pairs of each with the next three of its brand, and true links.
PARTS = """
rec AS (
  SELECT k, country, name, replace(name, ' ', '') AS compact, regexp_replace(name, '[aeiou]', '', 'g') AS skel, addr, nums, state, legal, addr = '' AS addr_empty
  FROM (
    SELECT p_partkey AS k, p_brand AS country, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || lower(p_type) ELSE '' END AS name,
      CASE WHEN p_partkey % 5 = 0 THEN '' ELSE lower(p_type) || ' ' || string_split(p_name, ' ')[1] END AS addr,
      CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_size || ' ' || p_partkey % 10 END AS nums,
      CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ca' ELSE 'tx' END AS state, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'llc' END AS legal
    FROM part)
), nxt AS (
  SELECT k, country, unnest([1, 2, 3]) AS step, unnest([lead(k, 1) OVER w, lead(k, 2) OVER w, lead(k, 3) OVER w]) AS j FROM rec WINDOW w AS (PARTITION BY country ORDER BY k)
), pred AS (
  SELECT CASE WHEN k % 2 = 0 THEN 'S2-' ELSE 'S3-' END || k AS tid, 'S1-' || j AS s1, k, j, step, country, ((k * 7919 + j * 104729) % 9973 + 1) / 9975.0::DOUBLE AS p FROM nxt WHERE j IS NOT NULL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, s1) AS rank FROM pred
), best AS (SELECT * FROM ranked WHERE rank = 1
), links AS (SELECT tid, s1 FROM pred WHERE step = 1 AND k % 4 <> 0
)"""


def words(a: str) -> str:
    return f"[x FOR x IN string_split({a}, ' ') IF x <> '']"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence, a row of the table for each character of b."""
    step = f"CASE WHEN ord(substr({a}, j[1], 1)) = cb[1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], acc[j[1]]) END"
    start = f"[list_transform(range(length({a}) + 1), lambda z: 0::BIGINT)]"
    rest = f"list_transform(string_split({b}, ''), lambda c: [coalesce(ord(c), 0)::BIGINT])"
    fold = f"list_reduce(list_transform(range(length({a}) + 1), lambda z: [z]), lambda acc, j: list_append(acc, {step}))"
    return f"list_reduce(list_concat({start}, {rest}), lambda row, cb: {fold})[length({a}) + 1]"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1 ELSE 2 * {lcs(a, b)} / (length({a}) + length({b})) END"


def similarities(n: str, pairs: str, partial: bool = True) -> str:
    """CTE ``n`` (a, b, ratio, sorted, "set", partial, jw) of the distinct pairs that the query ``pairs`` (a, b) gives."""
    more = ""
    if partial:
        more = f""", {n}_d AS (
  SELECT a, b, a AS s, b AS l FROM {n}_p WHERE length(a) <= length(b) AND a <> '' UNION ALL SELECT a, b, b, a FROM {n}_p WHERE length(b) <= length(a) AND b <> ''
), {n}_w AS (SELECT a, b, s, substr(l, greatest(i, 0) + 1, least(i + length(s), length(l)) - greatest(i, 0)) AS w FROM (SELECT *, unnest(range(1 - length(s), length(l))) AS i FROM {n}_d)
), {n}_b AS (SELECT a, b, max(r) AS r FROM (SELECT a, b, {ratio('s', 'w')} AS r FROM (SELECT DISTINCT * FROM {n}_w)) GROUP BY a, b)"""
    return f"""
{n}_p AS (SELECT DISTINCT * FROM ({pairs})){more}, {n}_s AS (
  SELECT *, array_to_string(list_sort(list_intersect(x, y)), ' ') AS c, array_to_string(list_sort([z FOR z IN x IF NOT list_contains(y, z)]), ' ') AS ra, array_to_string(list_sort([z FOR z IN y IF NOT list_contains(x, z)]), ' ') AS rb
  FROM (SELECT a, b, list_distinct({words('a')}) AS x, list_distinct({words('b')}) AS y FROM {n}_p)
), {n}_l AS (SELECT *, length(c) + (c <> '')::INT + length(ra) AS la, length(c) + (c <> '')::INT + length(rb) AS lb, length(c) + (c <> '')::INT + {lcs('ra', 'rb')} AS sh FROM {n}_s
), {n} AS (
  SELECT q.a, q.b, {ratio('q.a', 'q.b')} AS ratio, {ratio(f"array_to_string(list_sort({words('q.a')}), ' ')", f"array_to_string(list_sort({words('q.b')}), ' ')")} AS sorted,
    CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN c <> '' AND (ra = '' OR rb = '') THEN 1
      ELSE greatest(2 * sh / (la + lb), CASE WHEN c <> '' THEN greatest(2 * length(c) / (length(c) + la), 2 * length(c) / (length(c) + lb)) ELSE 0 END) END::DOUBLE AS "set",
    {f"CASE WHEN q.a = '' OR q.b = '' THEN (q.a = q.b)::INT ELSE {n}_b.r END" if partial else 'NULL'}::DOUBLE AS partial, jaro_winkler_similarity(q.a, q.b) AS jw
  FROM {n}_l q {f'LEFT JOIN {n}_b ON q.a = {n}_b.a AND q.b = {n}_b.b' if partial else ''}
)"""


def _pairs(a: str, joint: str) -> str:
    return f"[{a}[i] || '{joint}' || {a}[i + 1] FOR i IN range(1, greatest(len({a}), 1))]"


def _cross(a: str, b: str, joint: str) -> str:
    return f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: x || '{joint}' || y)))"


#: Keys of the five channels, their weights, cosines, and the union of each channel's ten best.
CHANNELS = f"""
ka AS (
  SELECT k, country, skel, compact, {words('name')} AS n, {words('skel')} AS s, {words('nums')} AS m, [x FOR x IN {words('addr')} IF length(x) >= 3] AS ad,
    regexp_replace(' ' || compact || ' ', '  +', ' ', 'g') AS pad
  FROM rec
), kb AS (
  SELECT k, country, 'name_ngram' AS channel, unnest(CASE WHEN length(pad) >= 4 THEN [substr(pad, i, 4) FOR i IN range(1, length(pad) - 2)] ELSE [pad] END) AS key FROM ka
  UNION ALL SELECT k, country, 'phon_key', unnest(list_concat(['F:' || replace(skel, ' ', '')], [x FOR x IN s IF length(x) >= 2], {_pairs('s', '_')})) FROM ka
  UNION ALL SELECT k, country, 'mix_key', unnest(list_concat({_cross('[x FOR x IN s IF length(x) >= 2][1:3]', 'ad[1:8]', '|')}, {_cross('[x FOR x IN s IF length(x) >= 2][1:3]', 'm[1:4]', '#')})) FROM ka
  UNION ALL SELECT k, country, 'name_key', unnest(list_concat([x FOR x IN n IF length(x) >= 2], {_pairs('n', '_')}, CASE WHEN length(compact) >= 6 THEN ['P:' || substr(compact, 1, 6)] ELSE [] END)) FROM ka
  UNION ALL SELECT k, country, 'addr_key', unnest(list_concat({_cross('m[1:3]', 'ad[1:4]', ':')}, {_pairs('ad', '_')})) FROM ka
), ktf AS (SELECT k, country, channel, key, count(*) AS tf FROM kb GROUP BY ALL
), kn AS (SELECT country, count(DISTINCT k) AS n FROM ktf GROUP BY country
), kidf AS (
  SELECT country, channel, key, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT country, channel, key, count(*) AS df FROM ktf GROUP BY ALL) JOIN kn USING (country)
  WHERE df <= CASE WHEN channel = 'name_ngram' THEN greatest(1, floor(n * 0.002::DOUBLE)) ELSE 200 END
), kx AS (SELECT k, country, channel, key, CASE WHEN channel = 'name_ngram' THEN 1 + ln(tf) ELSE tf END * idf AS w FROM ktf JOIN kidf USING (country, channel, key)
), kw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY k, channel)) AS u FROM kx
), kc AS (SELECT a.k AS k, b.k AS j, a.country, a.channel, sum(a.u * b.u) AS cos FROM kw a JOIN kw b USING (country, channel, key) GROUP BY ALL HAVING sum(a.u * b.u) > 0.05
), kt AS (SELECT * FROM kc QUALIFY row_number() OVER (PARTITION BY k, channel ORDER BY round(cos, 9) DESC, 'S1-' || j) <= 10
), un AS (
  SELECT k, j, country, {', '.join(f"coalesce(max(cos) FILTER (channel = '{c}'), 0)::DOUBLE AS {c}" for c in ('name_ngram', 'phon_key', 'mix_key', 'name_key', 'addr_key'))} FROM kt GROUP BY ALL
)"""


def prefiltered(prefilter: dict) -> str:
    """CTE ``cand``: the union's pairs with cheap similarities, the prefilter's logit, and the eight best."""
    terms = " + ".join(f"{c}::DOUBLE * {f}" for c, f in zip(prefilter["coef"], prefilter["features"], strict=True))
    return f"""{similarities('cn', "SELECT t.name AS a, s.name AS b FROM un JOIN rec t ON un.k = t.k JOIN rec s ON un.j = s.k", partial=False)},
{similarities('ca', "SELECT concat_ws(' ', t.addr, t.nums) AS a, concat_ws(' ', s.addr, s.nums) AS b FROM un JOIN rec t ON un.k = t.k JOIN rec s ON un.j = s.k", partial=False)}, ch AS (
  SELECT un.*, cn."set" AS pf_name, ca."set" AS pf_addr FROM un JOIN rec t ON un.k = t.k JOIN rec s ON un.j = s.k JOIN cn ON t.name = cn.a AND s.name = cn.b
    JOIN ca ON concat_ws(' ', t.addr, t.nums) = ca.a AND concat_ws(' ', s.addr, s.nums) = ca.b
), cand AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(pf_score, 9) DESC, 'S1-' || j) AS pf_rank FROM (SELECT *, {prefilter['intercept']}::DOUBLE + {terms} AS pf_score FROM ch)
  QUALIFY pf_rank <= 8
)"""


def _shared(field: str) -> tuple[str, str]:
    x, y = (f"list_distinct({words(f'{s}.{field}')})" for s in "ts")
    return f"len(list_intersect({x}, {y}))", f"len(list_intersect({x}, {y})) / greatest(len(list_distinct(list_concat({x}, {y}))), 1)"


def features() -> str:
    """CTE ``feat``: the 41 features of the pairs of ``cand``, unrounded."""
    sims = ",".join(similarities(f"f_{f}", f"SELECT t.{f} AS a, s.{f} AS b FROM cand JOIN rec t ON cand.k = t.k JOIN rec s ON cand.j = s.k", partial=f != "skel") for f in ("name", "compact", "skel", "addr"))
    joins = " ".join(f"JOIN f_{f} ON t.{f} = f_{f}.a AND s.{f} = f_{f}.b" for f in ("name", "compact", "skel", "addr"))
    over = ", ".join(f"{_shared(f)[0]}::DOUBLE AS {n}_shared, {_shared(f)[1]}::DOUBLE AS {n}_jac" for n, f in (("num", "nums"), ("addr_word", "addr"), ("name_tok", "name")))
    return f"""{sims}, top1 AS (SELECT j, count(*) AS n FROM cand WHERE pf_rank = 1 GROUP BY j), feat AS (
  SELECT CASE WHEN t.k % 2 = 0 THEN 'S2-' ELSE 'S3-' END || t.k AS tid, 'S1-' || s.k AS s1, t.country AS t_country, name_ngram, phon_key, mix_key, name_key, addr_key, pf_name, pf_addr, pf_score, pf_rank::INT AS pf_rank,
    f_name.ratio AS n_ratio, f_name."set" AS n_tset, f_name.sorted AS n_tsort, f_name.partial AS n_partial, f_compact.ratio AS c_ratio, f_compact.partial AS c_partial, f_compact.jw AS c_jw,
    f_skel.ratio AS k_ratio, f_skel."set" AS k_tset, f_addr.ratio AS a_ratio, f_addr."set" AS a_tset, f_addr.partial AS a_partial, {over},
    (t.nums <> '' AND string_split(t.nums, ' ')[1] = string_split(s.nums, ' ')[1])::INT AS num_first_eq, (t.nums <> '')::INT AS t_has_num, t.addr_empty::INT AS t_addr_empty_i,
    CASE WHEN t.state = '' OR s.state = '' THEN -1 ELSE (t.state = s.state)::INT END AS state_eq, CASE WHEN t.legal = '' OR s.legal = '' THEN -1 ELSE (t.legal = s.legal)::INT END AS legal_eq,
    length(t.name)::INT AS t_name_len, length(s.name)::INT AS s_name_len, len(string_split(t.name, ' '))::INT AS t_name_ntok, (t.k % 2)::INT AS is_s3,
    max(pf_score) OVER w - pf_score AS pf_gap, max(f_name."set") OVER w - f_name."set" AS n_tset_gap, max(f_addr."set") OVER w - f_addr."set" AS a_tset_gap, (count(*) OVER w)::INT AS n_cands, coalesce(top1.n, 0)::INT AS s1_top1_count
  FROM cand JOIN rec t ON cand.k = t.k JOIN rec s ON cand.j = s.k {joins} LEFT JOIN top1 ON cand.j = top1.j WINDOW w AS (PARTITION BY cand.k)
)"""
