"""From pair probabilities to lists: one reference record for a target, then the prefix of best expected F0.5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accepted probability at least, for countries that were not seen in training.
UNSEEN_THRESHOLD = 0.6


def best_links(pred: DataFrame) -> DataFrame:
    """Each target's most probable pair; ties go to the smaller s1."""
    return pred.withColumn("__r", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("p"), "s1"))).where("__r = 1").drop("__r")


def expected_prefixes(pred: DataFrame, threshold: Column | float) -> DataFrame:
    """The accepted best links, with ``k`` in order of p, ``f`` the expected F0.5 of the first k, ``f0`` of none, and ``keep``, the best number.

    With T the mass of all best links of the record, f(k) = 1.25 S(k) / (0.25 T + k) for the sum S of the first k; f0 is the
    probability that none is true, the product of 1 - p over accepted links times e to the minus mass of others.
    """
    best = best_links(pred).withColumn("ok", F.col("p") >= threshold)
    by = Window.partitionBy("s1")
    total, miss = F.sum("p").over(by), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("p"))).over(by), F.lit(0.0))
    order = by.orderBy(F.desc("p"), "tid")
    d = best.withColumns({"total": total, "miss": miss}).where("ok").drop("ok")
    d = d.withColumns({"k": F.row_number().over(order), "mass": F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)), "f0": F.product(1 - F.col("p")).over(by) * F.exp(-F.col("miss"))})
    d = d.withColumn("f", 1.25 * F.col("mass") / (0.25 * F.col("total") + F.col("k")))
    top = F.max(F.struct("f", (-F.col("k")).alias("k"))).over(by)
    return d.withColumn("top", top).withColumn("keep", F.when(F.col("top.f") > F.col("f0"), -F.col("top.k")).otherwise(0)).drop("top", "mass")


def assign(pred: DataFrame, threshold: Column | float, expected_f: bool = True) -> DataFrame:
    """``s1, tids``: each record's targets in order of p. ``threshold`` may be a column of ``pred``, such as a country's."""
    if expected_f:
        kept = expected_prefixes(pred, threshold).where("k <= keep")
    else:
        kept = best_links(pred).where(F.col("p") >= threshold)
    return kept.groupBy("s1").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("n"), "tid"))), lambda x: x["tid"]).alias("tids"))


def country_thresholds(pred: DataFrame, base: float, seen: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """``country, rate, threshold``: the accepted share at ``base``; a country that isn't in ``seen`` gets UNSEEN_THRESHOLD at least."""
    rate = best_links(pred).groupBy("country").agg(F.avg((F.col("p") >= base).cast("double")).alias("rate"))
    d = rate.join(seen.select("country").distinct().withColumn("known", F.lit(True)), "country", "left")
    threshold = F.when(F.col("known"), F.lit(base)).otherwise(F.lit(max(base, UNSEEN_THRESHOLD)))
    for c, t in (overrides or {}).items():
        threshold = F.when(F.col("country") == c, F.lit(t)).otherwise(threshold)
    return d.select("country", "rate", threshold.alias("threshold"))


def assign_by_country(pred: DataFrame, thresholds: DataFrame, expected_f: bool = True) -> DataFrame:
    """assign() with each country's threshold."""
    return assign(pred.join(thresholds.select("country", "threshold"), "country"), F.col("threshold"), expected_f)
