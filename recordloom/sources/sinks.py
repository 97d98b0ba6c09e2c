"""Sinks: id lists, stage tables that are made once, JSON, CSV."""

from __future__ import annotations

import json
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def id_lists(records: DataFrame, lists: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """``source1_entity_id, <column>``: a row for each record (entity_id), its distinct ids comma-joined, empty without any.

    Rows follow ``order``, a column of ``records``, if one is given.
    """
    d = records.select(F.col("entity_id").alias("s1"), *([F.col(order).alias("__o")] if order else [])).join(lists.select("s1", "tids"), "s1", "left")
    d = d.orderBy("__o") if order else d
    return d.select(F.col("s1").alias("source1_entity_id"), F.coalesce(F.array_join(F.array_distinct("tids"), ","), F.lit("")).alias(column))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header, no quotes, ``\\n`` line ends; a folder of part files."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("lineSep", "\n").csv(path)


def rewrite_country(result: DataFrame, new_lists: DataFrame, records: DataFrame, country: str) -> DataFrame:
    """A result table with one country's lists replaced by sorted new ones."""
    a, b = result.columns[:2]
    d = result.join(records.select(F.col("entity_id").alias(a), "country"), a, "left").join(new_lists.select(F.col("s1").alias(a), F.array_join(F.sort_array("tids"), ",").alias("__new")), a, "left")
    return d.select(a, F.when(F.col("country") == country, F.coalesce("__new", F.lit(""))).otherwise(F.col(b)).alias(b))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The table at ``path``, made and written first unless an earlier run finished it."""
    if not exists(spark, f"{path}/_SUCCESS"):
        w = make().write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.parquet(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_zip(spark: SparkSession, tables: dict[str, str], path: str) -> None:
    """One archive of delimited tables: name in the archive -> folder of part files, each with a header. Part files come one at a time, in their order."""
    with tempfile.TemporaryDirectory() as local:
        packed = Path(local) / "tables.zip"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for name, folder in tables.items():
                parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).orderBy("path").select("content")
                with z.open(name, "w", force_zip64=True) as f:
                    for i, r in enumerate(parts.toLocalIterator()):
                        body = bytes(r.content)
                        f.write(body if not i else body.partition(b"\n")[2])
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{packed}"), target)
