"""Sources: delimited record files, truth, Parquet and JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")


@dataclass(frozen=True)
class Layout:
    """Where the files of a run are."""

    data: str
    work: str
    output: str

    def source(self, split: str, number: int) -> str:
        return f"{self.data}/{split}/{split}_source{number}.tsv"

    def truth(self, split: str) -> str:
        return f"{self.data}/{split}/{split}_ground_truth.tsv"

    def work_file(self, split: str, name: str) -> str:
        return f"{self.work}/{split}/{name}"


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, quoted: bool = False) -> DataFrame:
    """A tab-separated file with a header, all strings, missing values empty. Quotes are ordinary characters unless ``quoted``.

    With ``columns`` the file isn't looked at beforehand.
    """
    r = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("quote", '"' if quoted else "").option("escape", "\0").option("mode", "PERMISSIVE")
    if columns:
        r = r.schema(", ".join(f"`{c}` string" for c in columns)).option("enforceSchema", False)
    return r.csv(path).fillna("")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path).select(*RECORD_COLUMNS)


def read_targets(spark: SparkSession, *paths: str) -> DataFrame:
    """The records of all target sources, one after the other; the id's prefix tells the source."""
    out = None
    for p in paths:
        d = read_records(spark, p)
        out = d if out is None else out.unionByName(d)
    return out


def only(df: DataFrame, ids: DataFrame, columns: tuple[str, ...] = RECORD_COLUMNS) -> DataFrame:
    """Some columns of the records whose ids are listed (column entity_id)."""
    return df.select(*columns).join(ids.select("entity_id"), "entity_id", "left_semi")


def split_ids(col: str) -> Column:
    """The distinct ids of a comma-joined list; none for an empty one."""
    return F.when(F.coalesce(F.col(col), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(col, ",")))


def truth_lists(truth: DataFrame) -> DataFrame:
    """``s1, tids`` of a truth or result table (id, list)."""
    a, b = truth.columns[:2]
    return truth.select(F.col(a).alias("s1"), split_ids(b).alias("tids"))


def truth_links(truth: DataFrame) -> DataFrame:
    """``tid, s1``: a row for each link."""
    return truth_lists(truth).select(F.explode("tids").alias("tid"), "s1")


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON object, from any file system that Spark reads."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def read_parquet(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.select(*columns) if columns else d
