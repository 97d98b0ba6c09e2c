"""Operator 10: quality rules with cross-document line frequency, in DataFrame functions only.

A line that many documents of one host share is boilerplate there. One scan of the texts writes the facts of each document: its base counts,
and a hash and the number of words of each normalised line. Lines are counted from these, one for each document and distinct line,
summed before they are exchanged. The frequent lines then meet the facts: while they are few, by a broadcast
of each host's; else by a join on (host, line), in which the rows of a hot line are dealt to several tasks, and whose findings, one row for a document, go back
by the document's number. Texts are never exchanged by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A line is frequent in more than this share of its host's documents, and in more than so many of them.
SHARE, LEAST_DOCS = 0.1, 5
#: A document is depleted if fewer words than this, or less than this share of its words, remain.
LEAST_WORDS, LEAST_SHARE = 10, 0.3
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Up to so many frequent lines are broadcast.
BROADCAST_LINES = 1 << 17


def normalised(line: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends. Most lines have single spaces only, and need no pattern."""
    plain = F.btrim(line, F.lit(common.SPACE_CHARS))
    uneven = line.contains("  ")
    for c in common.SPACE_CHARS[1:]:
        uneven = uneven | line.contains(c)
    return F.lower(F.when(uneven, F.regexp_replace(plain, rf"[{common.SPACE}]+", " ")).otherwise(plain))


def host_key(col: str) -> Column:
    """Never null, so that documents without a host are one host of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def frequent_lines(facts: DataFrame, share: float = SHARE, least_docs: int = LEAST_DOCS, distinct_texts: bool = False) -> DataFrame:
    """``host, h, docs``: the lines that are in too many documents of their host, and in how many.

    With ``distinct_texts``, copies of a text in a host count as one document, in the lines' counts and in the limit.
    """
    d = facts.select("host", "k1", "k2", F.array_compact(F.array_distinct("lines.h")).alias("hashes"))
    if distinct_texts:
        d = d.dropDuplicates(["host", "k1", "k2"])
    counts = d.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    limits = d.groupBy("host").agg(F.greatest(F.lit(float(least_docs)), F.count(F.lit(1)) * share).alias("most"))
    return counts.where(F.col("docs") > least_docs).join(limits, "host").where(F.col("docs") > F.col("most")).select("host", "h", "docs")


def repeated_words(d: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``: the words in WINDOW-word windows that are found twice or more in the text, each word once.

    Windows are compared by hashes. Only a text that has equal ones sorts them, to find where they stand.
    Each step is a column of its own, so that it is evaluated once for a text and not once for a window.
    """
    d = d.withColumn("__wh", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("__wh")
    window = lambda i: F.xxhash64(*[F.get(F.col("__wh"), i + k) for k in range(WINDOW)])
    d = d.withColumn("__win", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))).drop("__wh")
    some = F.size(F.array_distinct("__win")) < F.size("__win")
    d = d.withColumn("__srt", F.when(some, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__win")
    srt = F.col("__srt")
    equal = lambda j, k: F.get(srt, j)["h"] == F.get(srt, j + k)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__srt") - 1, F.lit(0))), lambda j: equal(j, -1) | equal(j, 1))
    d = d.withColumn("__at", F.when(srt.isNotNull(), F.sort_array(F.transform(twice, lambda j: F.get(srt, j)["i"])))).drop("__srt")
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end"))
    return d.withColumn(out, F.coalesce(F.aggregate("__at", zero, step)["n"], F.lit(0)).cast("long")).drop("__at")


def facts(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``uid, host, k1, k2``, the columns ``keep`` (as __keep_ and the name), base counts and ``lines``, an array of (h, n): hash (null without words) and words.

    Written; ``uid`` numbers the rows. One scan of the texts; ``with_text`` carries them along.
    """
    text = F.col("__text")
    d = docs.select(F.monotonically_increasing_id().alias("uid"), *[F.col(c).alias(f"__keep_{c}") for c in keep], host_key(host_col).alias("host"), common.text_of(text_col).alias("__text"))
    trimmed = F.btrim(text, F.lit(common.SPACE_CHARS))
    d = d.withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{common.SPACE}]+")))
    d = d.withColumns({"n_words": F.size("__words").cast("long"), "word_chars": F.length(F.array_join("__words", "")).cast("long")})
    d = repeated_words(d, "__words", "n_repeat_words").drop("__words")
    d = d.withColumn("__lines", F.split(text, "\n"))
    with_words = F.filter("__lines", lambda x: F.btrim(x, F.lit(common.SPACE_CHARS)) != "")
    fact = lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))).otherwise(F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("n")))
    d = d.withColumns(
        {
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(with_words) - F.size(F.array_distinct(with_words))).cast("long"),
            "lines": F.transform(F.transform("__lines", normalised), fact),
            "k1": F.xxhash64(text),
            "k2": F.xxhash64(text, F.lit(1)),
        }
    )
    return common.materialize(d.select("uid", "host", "k1", "k2", *[f"`__keep_{c}`" for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", *["__text"] * with_text))


def with_removed(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """Adds ``removed``, the hashes of a document's frequent lines, to facts()'s rows. ``frequent`` is written."""
    none = F.array().cast("array<bigint>")
    if frequent.count() <= BROADCAST_LINES:
        of_host = frequent.groupBy("host").agg(F.collect_list("h").alias("frequent"))
        d = rows.join(F.broadcast(of_host), "host", "left")
        return d.withColumn("removed", F.when(F.col("frequent").isNull(), none).otherwise(F.array_intersect("lines.h", "frequent"))).drop("frequent")
    lines = rows.select("uid", "host", F.explode(F.array_compact(F.array_distinct("lines.h"))).alias("h"))
    met = common.spread_join(lines, frequent.select("host", "h"), ["host", "h"], frequent, "docs")
    return rows.join(met.groupBy("uid").agg(F.collect_list("h").alias("removed")), "uid", "left").withColumn("removed", F.coalesce("removed", none))


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), share: float = SHARE, least_docs: int = LEAST_DOCS, distinct_texts: bool = False, with_text: bool = False) -> DataFrame:
    """The columns ``keep``, the base counts, ``n_removed_words``, ``kept`` and, ``with_text``, ``cleaned``: the text without frequent lines.

    A null text counts as empty; it has no words and fails. Documents whose host is null are one host. Repeated rows are
    documents of their own, and count as such unless ``distinct_texts`` is set (see frequent_lines()). No other columns are read; an empty table gives an empty result.
    Reads ``docs`` once.
    """
    rows = facts(docs, host_col, text_col, keep, with_text)
    frequent = common.materialize(frequent_lines(rows, share, least_docs, distinct_texts))
    d = with_removed(rows, frequent)
    gone = lambda x: F.array_contains(F.col("removed"), x["h"])
    some = F.size("removed") > 0
    n = F.when(some, F.aggregate("lines", F.lit(0), lambda a, x: a + F.when(gone(x), x["n"]).otherwise(0))).otherwise(0).cast("long")
    d = d.withColumn("n_removed_words", n)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < LEAST_WORDS) | (left < LEAST_SHARE * F.col("n_words"))
    out = [*[F.col(f"`__keep_{c}`").alias(c) for c in keep], *[F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), F.col("n_removed_words"), (~failed & ~depleted).alias("kept")]
    if with_text:
        rest = F.filter(F.split("__text", "\n"), lambda x, i: ~F.coalesce(gone(F.get("lines", i)), F.lit(False)))
        out.append(F.when(some, F.array_join(rest, "\n")).otherwise(F.col("__text")).alias("cleaned"))
    return d.select(*out)


def passing_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text", distinct_texts: bool = False) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, all columns, with their frequent lines removed.

    Null, empty and blank texts go, as they have too few words. Hosts and other columns may be null and have any names; repeated rows stay
    repeated or go together; an empty table gives an empty result.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(1).alias("none")]
    d = docs.select(F.struct(*others).alias("__row"), F.col(host_col).alias("__host"), F.col(text_col).alias("__text"))
    d = judge(d, "__host", "__text", ("__row",), distinct_texts=distinct_texts, with_text=True).where("kept")
    return d.select(*[F.col("cleaned" if c == text_col else f"__row.`{c}`").alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM d
), l AS (
  SELECT rid, host, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
    len([x FOR x IN regexp_split_to_array(line, '[\x20\x09-\x0D]+') IF x <> '']) AS nw
  FROM (SELECT rid, host, unnest(lines) AS line FROM w)
), hosts AS (SELECT host, greatest(5.0, count(*) * 0.1::DOUBLE) AS most FROM d GROUP BY host),
frequent AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT rid) AS docs FROM l GROUP BY host, norm) c JOIN hosts USING (host)
  WHERE c.docs > hosts.most
), removed AS (SELECT rid, sum(nw) AS n FROM l JOIN frequent USING (host, norm) GROUP BY rid),
win AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)
), twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), b AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN removed USING (rid)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND n_words - n_removed_words >= 10 AND n_words - n_removed_words >= 0.3::DOUBLE * n_words AS kept
FROM b
"""
