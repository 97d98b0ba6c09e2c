"""Checks of result files, as one table of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES = 5
FINDING = "rule string, severity string, n long, examples array<string>"


def _finding(df: DataFrame, rule: str, severity: str, what: str) -> DataFrame:
    """One row, or none if ``df`` has no rows: how many offenders there are, and the first few."""
    d = df.select(F.col(what).cast("string").alias("x")).distinct()
    top = d.orderBy("x").limit(EXAMPLES).agg(F.array_sort(F.collect_list("x")).alias("examples"))
    return d.agg(F.count(F.lit(1)).alias("n")).where("n > 0").crossJoin(top).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def parse_lines(lines: DataFrame) -> DataFrame:
    """``line, s1, ids`` of a file's lines (value) without its header; ids is null where a line has no tab."""
    p = F.split("value", "\t", 2)
    return lines.select(F.col("value").alias("line"), p[0].alias("s1"), F.when(F.size(p) > 1, F.when(F.trim(p[1]) == "", F.array().cast("array<string>")).otherwise(F.split(p[1], ","))).alias("ids"))


def check_lists(rows: DataFrame, records: DataFrame, label: str, known: DataFrame | None = None) -> DataFrame:
    """Findings over parsed rows: malformed, repeated or missing records, repeated, own, strange or unknown ids."""
    good = rows.where(F.col("ids").isNotNull())
    ids = good.select("s1", F.explode("ids").alias("tid"))
    need = records.select(F.col("entity_id").alias("s1")).distinct()
    s1, s23 = F.col("tid").startswith("S1-"), F.col("tid").rlike("^S[23]-")
    found = [
        (rows.where(F.col("ids").isNull() & (F.trim("line") != "")), "malformed row", "line"),
        (good.groupBy("s1").count().where("count > 1"), "duplicate row", "s1"),
        (good.where(F.size("ids") != F.size(F.array_distinct("ids"))), "repeated id in a list", "s1"),
        (ids.where(s1), "self match", "tid"),
        (ids.where(~s1 & ~s23), "wrong prefix", "tid"),
        (need.join(good, "s1", "left_anti"), "missing record", "s1"),
        (good.join(need, "s1", "left_anti"), "extra record", "s1"),
    ]
    if known is not None:
        found.append((ids.where(s23).join(known.select(F.col("entity_id").alias("tid")), "tid", "left_anti"), "unknown id", "tid"))
    out = None
    for d, rule, what in found:
        f = _finding(d, f"{label}: {rule}", "error", what)
        out = f if out is None else out.unionByName(f)
    return out


def validate_file(spark: SparkSession, path: str, column: str, records: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(findings, parsed rows); no rows where the header is wrong or there is none."""
    lines = spark.read.text(path)
    first = lines.select("value").head(1)
    header = [c.strip().lower() for c in first[0].value.split("\t")] if first else []
    want = ["source1_entity_id", column]
    if header != want:
        rule = "empty file" if not first else "comma-separated" if "\t" not in first[0].value and "," in first[0].value else "unexpected header"
        return spark.createDataFrame([(f"{column}: {rule}", "error", 1, [",".join(header)])], FINDING), None
    # the header of each part file goes once; a further line like it is a row
    at = F.col("_metadata.file_path")
    like = F.lower(F.trim(F.regexp_replace("value", r"\s*\t\s*", "\t"))) == "\t".join(want)
    heads = lines.select(at.alias("f"), like.alias("head")).where("head").groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    again = heads.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    body = lines.where(~like).select("value").unionByName(spark.range(again).select(F.lit("\t".join(want)).alias("value")))
    rows = parse_lines(body)
    return check_lists(rows, records, column, known), rows


def validate(spark: SparkSession, matching: str, candidates: str | None, records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``rule, severity, n, examples``: no rows of severity error means that the files are fine."""
    out, matched = validate_file(spark, matching, "matched_entity_ids", records, known)
    if candidates:
        more, cands = validate_file(spark, candidates, "candidate_entity_ids", records, known)
        out = out.unionByName(more)
        if matched is not None and cands is not None:
            pairs = lambda d: d.where(F.col("ids").isNotNull()).select("s1", F.explode("ids").alias("tid"))
            outside = pairs(matched).join(pairs(cands), ["s1", "tid"], "left_anti")
            out = out.unionByName(_finding(outside, "matched_entity_ids: not among candidates", "warning", "s1"))
    return out
