"""What the operators of this folder share: the shared work folder, written tables, input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import delete, discard, materialize, read_work, ship_package, watched, work_dir  # noqa: F401

#: Rows and bytes of one Arrow batch, so that a batch of very long texts stays small.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20

#: The white space that separates words: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_row(df: DataFrame) -> DataFrame:
    """df, written, with ``__row``: a number for each row that stays the same when it is read again."""
    return materialize(df.withColumn("__row", F.monotonically_increasing_id()))


def small_batches(spark: SparkSession) -> None:
    """Before Python code runs on executors: they get this package, and their Arrow batches are bounded."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words; zero for an empty text."""
    t = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, rf"[{SPACE}]+"))).cast("long")


def salt_count(rows: int, each: int = 50_000, least: int = 32, most: int = 1 << 16) -> int:
    """Parts into which each group is dealt, so that a group of all rows still leaves about ``each`` rows to a part."""
    return int(min(most, max(least, -(-rows // each))))


#: A key is hot if more than so many rows have it, and more than one in so many of all rows.
HOT_ROWS, HOT_SHARE = 256, 4096


def hot_keys(counted: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``keys, __salts`` of the hot keys of ``counted``, which has a row for each key with its number of rows.

    Fewer than HOT_SHARE keys can be hot, whatever the input's size, and their salts add up to at most twice that.
    """
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    most = max(HOT_ROWS, total // HOT_SHARE)
    return counted.where(F.col(n) > most).select(*keys, F.ceil(F.col(n) / most).cast("int").alias("__salts"))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], counted: DataFrame, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one row for each key, on ``keys``, none of them null.

    The rows of a hot key are dealt to several tasks, each of which gets that key's row of ``table``. ``counted`` has the rows of each key.
    ``rows`` must come from a written table, so that a task that runs again deals its rows as before.
    """
    hot = hot_keys(counted, keys, n)
    salts = F.coalesce("__salts", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop("__salts")
    right = table.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
