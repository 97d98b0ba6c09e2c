"""Operator 2: secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each kind's pattern marks its matches in the text; cutting at the marks gives the matches' places. Values found by
the base kinds, and other live-looking tokens, are candidates. Their hashes are counted by distinct repositories and owners over
the whole corpus, with sums before each exchange. A value under many owners, or in many repositories, is a widely copied example; any other
is specific to its owners. Live-looking tokens that are owner-specific become spans of the kind ``owned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base kinds, in their order; group 2 of ``assign`` is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: A live-looking token: so many characters, three letters and three digits at least.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: From so many owners on, or so many repositories, a value is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 4, 6
MARK, ELSE = "\x01", "\x02"
SHIFT = 1 << 31


def found(text: Column, quick: str, pattern: str, good) -> Column:
    """Matches of ``pattern`` for which good(match) holds, as structs start, end, value (code points, end exclusive).

    ``quick`` matches wherever a good match is, and spares most texts the marking. MARK must not be in the text.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        one = F.array(F.struct(a["at"].alias("start"), end.alias("end"), x.alias("value")))
        return F.struct(end.alias("at"), (~a["match"]).alias("match"), F.when(a["match"] & good(x), F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.when(text.rlike(quick), F.aggregate(pieces, zero, step)["out"]).otherwise(none)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...], row_col: str | None = None) -> DataFrame:
    """``uid, doc_id, owner, repo``, the base kinds' matches, and the live-looking tokens, without texts."""
    text = common.text_of(text_col)
    owner = F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit(""))
    repo = F.xxhash64(owner, *[F.col(c) for c in repo_cols])
    uid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    d = docs.select(uid.alias("uid"), F.col(id_col).alias("doc_id"), owner.alias("owner"), repo.alias("repo"), text.alias("t"))
    d = d.withColumn("t", F.when(F.col("t").contains(MARK), F.translate("t", MARK, ELSE)).otherwise(F.col("t")))
    t = F.col("t")
    value = lambda x: F.regexp_extract(x, ASSIGN, 2)
    d = d.withColumns(
        {
            "assign": found(t, ASSIGN, ASSIGN, lambda x: F.length(value(x)) >= LEAST_ASSIGN),
            "access": found(t, "AKIA[A-Z0-9]{16}", ACCESS, lambda x: F.length(x) >= LEAST_ACCESS),
            # runs are whole, so a run too short is no match either way
            "hex": found(t, f"[0-9a-f]{{{LEAST_HEX}}}", f"(?<![0-9a-f])[0-9a-f]{{{LEAST_HEX},}}", lambda x: F.lit(True)),
            "token": found(t, TOKEN, TOKEN, lambda x: x.rlike("(?:[0-9].*){3}") & x.rlike("(?:[A-Za-z].*){3}")),
        }
    )
    return d.select("uid", "doc_id", "owner", "repo", F.transform("assign", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), value(x["value"]).alias("value"))).alias("assign"), "access", "hex", "token")


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of structs start, kind (its place in KINDS), end, in that order."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def of_kind(col: str, kind: int) -> Column:
    return F.transform(col, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def candidates(rows: DataFrame) -> DataFrame:
    """``uid, owner, repo, h, kind, start, end``: base values, and tokens that aren't one of them."""
    code = lambda first, end: first.cast("long") * SHIFT + end
    base = F.concat(F.transform("assign", lambda s: code(s["end"] - F.length(s["value"]), s["end"])), F.transform("access", lambda s: code(s["start"], s["end"])), F.transform("hex", lambda s: code(s["start"], s["end"])))
    rows = rows.withColumn("new", F.array_except(F.transform("token", lambda s: code(s["start"], s["end"])), base))
    token = F.filter("token", lambda s: F.array_contains("new", code(s["start"], s["end"])))
    tagged = lambda col, kind: F.transform(col, lambda s: F.struct(F.xxhash64(s["value"]).alias("h"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.concat(tagged("assign", 0), tagged("access", 1), tagged("hex", 2), tagged(token, 3))
    return rows.select("uid", "owner", "repo", F.explode(every).alias("c")).select("uid", "owner", "repo", "c.*")


def ownership(cands: DataFrame) -> DataFrame:
    """``h, owners, repos, n``: the distinct owners and repositories of each candidate hash, and its occurrences."""
    by_repo = cands.groupBy("h", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("lang",), example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, row_col: str | None = None) -> DataFrame:
    """For each row ``uid`` (row_col), ``doc_id``, the base counts and digest, ``spans``, how many of its base spans' values are live or
    examples, and the owners and repositories of the most widespread candidate in it (zero without any).

    A null text is empty and has no spans. Rows with a null owner have one owner, so have rows with a null repository.
    Repeated rows are rows of their own, of one owner. Other columns aren't read. An empty table gives an empty result.
    """
    rows = common.materialize(scan(docs, id_col, text_col, owner_col, repo_cols, row_col))
    cands = common.materialize(candidates(rows))
    owned = common.materialize(ownership(cands))
    # a value that a third of all documents hold is judged in several tasks
    judged = common.spread_join(cands, owned.drop("n"), ["h"], owned)
    live = (F.col("owners") < example_owners) & (F.col("repos") < example_repos)
    added = F.collect_list(F.when(live & (F.col("kind") == 3), F.struct("start", "kind", "end")))
    by_doc = judged.groupBy("uid").agg(added.alias("added"), F.sum((live & (F.col("kind") < 3)).cast("long")).alias("live"), F.sum((~live & (F.col("kind") < 3)).cast("long")).alias("examples"), F.max("owners").alias("owners"), F.max("repos").alias("repos"))
    d = rows.join(by_doc, "uid", "left")
    base = F.concat(of_kind("assign", 0), of_kind("access", 1), of_kind("hex", 2))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return d.select(
        "uid", "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.concat(base, F.coalesce("added", none))).alias("spans"),
        F.coalesce("live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("examples", F.lit(0)).cast("long").alias("n_examples"),
        F.coalesce("owners", F.lit(0)).cast("long").alias("most_owners"), F.coalesce("repos", F.lit(0)).cast("long").alias("most_repos"),
    )


def redact(text: Column, spans: Column, by: str = "<SECRET>") -> Column:
    """The text with each run of overlapping spans (as find_secrets() writes them) replaced."""
    pairs = F.transform(F.filter(F.split(spans, ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, p: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["at"] + 1, p["s"] - a["at"]), F.lit(by))
        return F.struct(F.greatest(a["at"], p["e"]).alias("at"), F.when(p["s"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    end = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(spans == "", text).otherwise(F.aggregate(pairs, zero, step, end))


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("lang",)) -> DataFrame:
    """The rows of ``docs``, all columns, with every span of find_secrets() replaced in the text.

    Null, empty and very long texts, and texts without spans, stay as they are or lose their spans alone; ids, owners and other columns may be null and
    have any names; repeated rows stay repeated; an empty table gives an empty result.
    """
    d = common.with_row(docs)
    spans = find_secrets(d, id_col, text_col, owner_col, repo_cols, row_col="__row").where("spans <> ''")
    spans = common.materialize(spans.select(F.col("uid").alias("__row"), F.col("spans").alias("__spans")))
    d = d.join(spans, "__row", "left")
    return d.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(redact(F.col(text_col), F.col("__spans")))).select(*docs.columns)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.read(spark, sf_dir, "documents")).drop("uid")


def _kind_sql(name: str, pattern: str, good: str, value: str = "x") -> str:
    """Matches of a pattern: rid, s, e, v. Marks cut the text; matches are the even pieces."""
    p = pattern.replace("'", "''")
    return f"""{name}_p AS (
  SELECT rid, unnest(p) AS x, generate_subscripts(p, 1) AS i
  FROM (SELECT rid, string_split(regexp_replace(t, '{p}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM d)
), {name} AS (
  SELECT rid, s, s + length(x) AS e, {value.replace("PATTERN", p)} AS v FROM (SELECT *, (sum(length(x)) OVER (PARTITION BY rid ORDER BY i))::BIGINT - length(x) AS s FROM {name}_p)
  WHERE i % 2 = 0 AND {good.replace("PATTERN", p)}
)"""


#: Runs are whole in an engine whose patterns look for the leftmost longest one, so no look behind is needed.
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS owner, coalesce('=' || lang, '') AS repo, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
{_kind_sql("a", ASSIGN, "length(regexp_extract(x, 'PATTERN', 2)) >= 6", "regexp_extract(x, 'PATTERN', 2)")},
{_kind_sql("k", ACCESS, "length(x) >= 20")},
{_kind_sql("h", HEX, "length(x) >= 24")},
{_kind_sql("o", "[A-Za-z0-9+/_=-]{20,}", "regexp_matches(x, '(?:[0-9].*){3}') AND regexp_matches(x, '(?:[A-Za-z].*){3}')")},
base AS (
  SELECT rid, s, e, v, 0 AS kind, e - length(v) AS vs FROM a UNION ALL SELECT rid, s, e, v, 1, s FROM k UNION ALL SELECT rid, s, e, v, 2, s FROM h
), c AS (
  SELECT rid, s, e, v, kind FROM base UNION ALL SELECT rid, s, e, v, 3 FROM o WHERE NOT EXISTS (FROM base b WHERE b.rid = o.rid AND b.vs = o.s AND b.e = o.e)
), w AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM c JOIN d USING (rid) GROUP BY v
), j AS (SELECT c.*, owners, repos, owners < {EXAMPLE_OWNERS} AND repos < {EXAMPLE_REPOS} AS owned, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e AS span FROM c JOIN w USING (v)
), g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS na, count(*) FILTER (kind = 1) AS nk, count(*) FILTER (kind = 2) AS nh,
    string_agg(span, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind, e) FILTER (kind < 3 OR owned) AS spans,
    count(*) FILTER (kind < 3 AND owned) AS live, count(*) FILTER (kind < 3 AND NOT owned) AS examples,
    max(owners) AS most_owners, max(repos) AS most_repos
  FROM j GROUP BY rid
)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nk, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(live, 0) AS n_live, coalesce(examples, 0) AS n_examples, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN g USING (rid)
"""
