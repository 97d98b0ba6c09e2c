"""Samples and splits by hash: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DROP_SHARE, VAL_SHARE = 0.19, 0.02


def drawn(col: str, seed: int) -> Column:
    """A number of 32 bits for each value of a column; seeds are independent roles. By MD5, so that any engine draws the same."""
    return F.conv(F.substring(F.md5(F.concat(F.col(col).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")


def unit(col: str, seed: int) -> Column:
    """A number in [0, 1) for each value of a column."""
    return drawn(col, seed) / float(1 << 32)


def fold(col: str, n: int, seed: int) -> Column:
    return F.pmod(drawn(col, seed), F.lit(n)).cast("int")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """``n`` rows (of each group), those of smallest hash."""
    if not by:
        return df.orderBy(drawn(key, seed), key).limit(n)
    w = Window.partitionBy(*by).orderBy(drawn(key, seed), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def dropped_records(reference: DataFrame, share: float = DROP_SHARE, seed: int = 123) -> DataFrame:
    """``s1``: reference records left out to imitate targets that have no record."""
    return reference.select("s1").distinct().where(unit("s1", seed) < share)


def without_dropped(cands: DataFrame, dropped: DataFrame) -> DataFrame:
    """Candidates as if the dropped records had never been; ranks are counted anew."""
    order = Window.partitionBy("tid").orderBy(F.desc("pf_score"), "s1")
    return cands.join(dropped, "s1", "left_anti").withColumn("pf_rank", F.row_number().over(order))


def validation_split(cands: DataFrame, links: DataFrame, truth: DataFrame, dropped: DataFrame, share: float = VAL_SHARE, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held-out s1, targets that touch them, targets safe to train on).

    A target truly linked to a held-out record isn't safe, even if it isn't a candidate of it.
    """
    held = truth.select("s1").where(unit("s1", seed) < share).join(dropped, "s1", "left_anti")
    touched = cands.join(held, "s1", "left_semi").select("tid").distinct()
    linked = links.join(held, "s1", "left_semi").select("tid")
    pool = cands.select("tid").distinct().join(touched, "tid", "left_anti").join(linked, "tid", "left_anti")
    return held, touched, pool
