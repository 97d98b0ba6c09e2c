"""Macro F0.5 over reference records, and the search for the decision rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def f05(p: Column, r: Column) -> Column:
    return F.when(p * r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)


def entity_scores(truth: DataFrame, pred: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """``s1, p, r, f, single, single_ok, ceiling, n_cands`` for each record of ``truth`` (s1, tids); ``pred`` and ``cands`` too are (s1, tids).

    A record without true links scores 1 if nothing is predicted for it and else 0.
    """
    none = F.array().cast("array<string>")
    side = lambda d, n: d.select("s1", F.array_distinct("tids").alias(n))
    d = side(truth, "t").join(side(pred, "m"), "s1", "left")
    d = d.join(side(cands, "c"), "s1", "left") if cands is not None else d.withColumn("c", none)
    d = d.select("s1", *[F.coalesce(x, none).alias(x) for x in "tmc"])
    nt, nm = F.size("t"), F.size("m")
    tp = F.size(F.array_intersect("t", "m"))
    empty = (nm == 0).cast("double")
    p = F.when(nt == 0, empty).when(nm == 0, 0.0).otherwise(tp / nm)
    r = F.when(nt == 0, empty).when(nm == 0, 0.0).otherwise(tp / nt)
    ceiling = F.when(nt > 0, F.size(F.array_intersect("t", "c")) / nt)
    d = d.select("s1", p.alias("p"), r.alias("r"), (nt == 0).alias("single"), ((nt == 0) & (nm == 0)).alias("single_ok"), ceiling.alias("ceiling"), F.size("c").alias("n_cands"))
    return d.withColumn("f", f05(F.col("p"), F.col("r")))


def evaluate(truth: DataFrame, pred: DataFrame, cands: DataFrame | None = None, by: DataFrame | None = None) -> DataFrame:
    """One row (or one for each ``country`` of ``by``: s1, country) of macro scores."""
    d = entity_scores(truth, pred, cands)
    keys = []
    if by is not None:
        d, keys = d.join(by.select("s1", "country"), "s1"), ["country"]
    n = F.sum(F.col("single").cast("long"))
    return d.groupBy(*keys).agg(
        F.avg("f").alias("macro_f05"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.count(F.lit(1)).alias("entities"), n.alias("singletons"),
        F.when(n > 0, F.sum(F.col("single_ok").cast("long")) / n).otherwise(1.0).alias("singleton_accuracy"),
        F.coalesce(F.avg("ceiling"), F.lit(0.0)).alias("candidate_recall_ceiling"), F.avg("n_cands").alias("avg_candidates_per_entity"),
    )


def tune(pred: DataFrame, truth: DataFrame, cands: DataFrame | None = None) -> tuple[dict, list[dict]]:
    """The decision rule of best macro F0.5 (the first of equals), and the whole grid: one small job for each of its 16 points."""
    from .assignment import assign

    pred = pred.join(truth.select("s1"), "s1", "left_semi").persist()
    grid = []
    for expected_f in (False, True):
        for t in THRESHOLDS:
            row = evaluate(truth, assign(pred, t, expected_f), cands).first().asDict()
            grid.append({"threshold": t, "expected_f": expected_f} | row)
    pred.unpersist()
    best = max(grid, key=lambda g: g["macro_f05"])
    return {"threshold": best["threshold"], "expected_f": best["expected_f"]}, grid


def auc(scores: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """``positives, negatives, auc``: the chance that a positive scores above a negative, ties half. Null without both.

    Exact, and sorted in parts: distinct scores are summed up first, then counted below by parts of the score's range (scores in [0, 1]).
    """
    from pyspark.sql import Window

    d = scores.groupBy(F.col(score).alias("x")).agg(F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg"))
    d = d.withColumn("part", F.floor(F.col("x") * 4096).cast("int"))
    parts = d.groupBy("part").agg(F.sum("neg").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # 4,097 rows at most
    below = F.sum("neg").over(Window.partitionBy("part").orderBy("x")) - F.col("neg")
    won = d.withColumn("below", below).join(F.broadcast(base), "part").select("pos", "neg", (F.col("pos") * (F.col("base") + F.col("below") + F.col("neg") / 2)).alias("won"))
    return won.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("won").alias("won")).select("positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("won") / F.col("positives") / F.col("negatives")).alias("auc"))


def describe(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``column, n, mean, std, least, q1, median, q3, most`` of number columns, nulls left out; quartiles are exact."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), q.alias("q"), F.max("x").alias("most"))
    return d.select("column", "n", "mean", "std", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "most")
