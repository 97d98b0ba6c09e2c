"""Boosted trees over pair features: fit with early stopping, out-of-fold scores, scorers for pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.splits import fold

#: Roles of hashes of a target: early stopping, fold, half. Each is independent of the others.
STOP_SEED, FOLD_SEED, HALF_SEED = 42, 7, 11
MISSING = -1.0


def _ready(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Nulls and NaN become MISSING: trees here take no NaN."""
    return df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(MISSING)) for f in features})


def fit(df: DataFrame, features: tuple[str, ...], label: str = "y", rounds: int = 60, depth: int = 5, step: float = 0.15, group: str = "tid") -> PipelineModel:
    """Gradient-boosted trees; a tenth of the targets, chosen by hash, decides when to stop."""
    d = _ready(df, features).withColumns({"__y": F.col(label).cast("double"), "__stop": fold(group, 10, STOP_SEED) == 0})
    x = VectorAssembler(inputCols=list(features), outputCol="__x")
    trees = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, minInstancesPerNode=20, validationIndicatorCol="__stop", seed=STOP_SEED)
    return PipelineModel(stages=[x, trees.fit(x.transform(d))])


def predict(model: PipelineModel, df: DataFrame, features: tuple[str, ...], out: str = "p", keep: tuple[str, ...] = ("tid", "s1", "country")) -> DataFrame:
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(_ready(df, features)).select(*keep, p.alias(out))


def importances(model: PipelineModel, features: tuple[str, ...], top: int = 15) -> list[tuple[str, float]]:
    found = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, found), strict=True), key=lambda x: -x[1])[:top]


def out_of_fold(df: DataFrame, features: tuple[str, ...], folds: int = 2, **options) -> DataFrame:
    """``tid, s1, country, p``: each target scored by a model that was fitted without it."""
    out = None
    for k in range(folds):
        mine = fold("tid", folds, FOLD_SEED) == k
        p = predict(fit(df.where(~mine), features, **options), df.where(mine), features)
        out = p if out is None else out.unionByName(p)
    return out


def half(df: DataFrame, k: int) -> DataFrame:
    """One half of the targets, by a hash that is independent of folds."""
    return df.where(fold("tid", 2, HALF_SEED) == k)


def score_pairs(pairs: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], out: str = "ce") -> DataFrame:
    """``tid, s1`` and a score from any scorer that maps batches of (tid, s1, text_a, text_b) to (tid, s1, score)."""
    return pairs.select("tid", "s1", "text_a", "text_b").mapInPandas(scorer, f"tid string, s1 string, {out} double")


def pair_texts(pairs: DataFrame, reference: DataFrame, targets: DataFrame) -> DataFrame:
    """``tid, s1, text_a, text_b``: name and address of both records."""
    side = lambda d, key, n: d.select(F.col("entity_id").alias(key), F.concat_ws(" | ", "business_name", "business_address").alias(n))
    return pairs.select("tid", "s1").join(side(targets, "tid", "text_a"), "tid").join(side(reference, "s1", "text_b"), "s1")


def gram_cosine(pairs: DataFrame, reference: DataFrame, targets: DataFrame, n: int = 3, min_df: int = 2) -> DataFrame:
    """``tid, s1, ce``: the cosine of weighted character n-grams within words, a scorer that needs no training."""
    grams = lambda t: F.flatten(F.transform(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - n, F.lit(1))), lambda i: F.substr(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(n)))))
    text = pair_texts(pairs, reference, targets)
    every = text.select(F.col("tid").alias("id"), F.col("text_a").alias("t")).unionByName(text.select(F.col("s1").alias("id"), F.col("text_b").alias("t"))).dropDuplicates(["id"])
    tf = every.select("id", F.explode(grams(F.col("t"))).alias("g")).groupBy("id", "g").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    df = tf.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    docs = every.agg(F.count(F.lit(1)).alias("docs"))
    w = tf.join(df.crossJoin(F.broadcast(docs)), "g").select("id", "g", (F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)).alias("w"))  # docs is one row
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm, "id").select("id", "g", (F.col("w") / F.col("norm")).alias("w"))
    a = pairs.select("tid", "s1").join(w.select(F.col("id").alias("tid"), "g", F.col("w").alias("wa")), "tid")
    dot = a.join(w.select(F.col("id").alias("s1"), "g", F.col("w").alias("wb")), ["s1", "g"]).groupBy("tid", "s1").agg(F.sum(F.col("wa") * F.col("wb")).alias("ce"))
    return pairs.select("tid", "s1").join(dot, ["tid", "s1"], "left").fillna(0.0, subset=["ce"])
