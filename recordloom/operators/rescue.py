"""The rescue lane: targets without a good pair get their nearest records by vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocking import cheap_similarities
from .group_features import MIN_P, logit
from .splits import unit
from .vectors import dense_top_k

OPEN_P, DENSE_K = 0.7, 5
#: Targets whose best candidate is under this are looked at by widen(); this share of them is searched.
WIDE_P, WIDE_SHARE = 0.5, 0.2
RESCUE_FEATURES = ("ce", "ce_logit", "dense_cos", "dense_rank", "pf_name", "pf_addr", "best_p", "ce_rank_t", "ce_max_t", "ce_gap_t", "n_resc", "is_s3")


def open_targets(pred: DataFrame, below: float = OPEN_P) -> DataFrame:
    """``tid, country, best_p`` of targets whose best probability is below ``below``."""
    return pred.groupBy("tid").agg(F.max("p").alias("best_p"), F.first("country").alias("country")).where(F.col("best_p") < below)


def rescue_candidates(pred: DataFrame, cands: DataFrame, target_vectors: DataFrame, reference_vectors: DataFrame, targets: DataFrame, reference: DataFrame, k: int = DENSE_K) -> DataFrame:
    """``tid, s1, country, dense_cos, dense_rank, best_p, pf_name, pf_addr, is_s3``: nearest records that aren't candidates yet."""
    opened = open_targets(pred)
    near = dense_top_k(target_vectors.join(opened.select(F.col("tid").alias("entity_id")), "entity_id", "left_semi"), reference_vectors, k)
    new = near.join(cands.select("tid", "s1"), ["tid", "s1"], "left_anti").join(opened.select("tid", "best_p"), "tid")
    d = cheap_similarities(new, reference, targets).fillna(0.0, subset=["pf_name", "pf_addr"])
    return d.withColumn("is_s3", F.col("tid").startswith("S3").cast("int"))


def rescue_features(rescue: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds RESCUE_FEATURES from a pair score (tid, s1, ce)."""
    t = Window.partitionBy("tid")
    d = rescue.join(scores.select("tid", "s1", "ce"), ["tid", "s1"])
    return d.withColumns({"ce_logit": logit(F.col("ce")), "ce_rank_t": F.row_number().over(t.orderBy(F.desc("ce"), "s1")), "ce_max_t": F.max("ce").over(t), "ce_gap_t": F.max("ce").over(t) - F.col("ce"), "n_resc": F.count(F.lit(1)).over(t).cast("int")})


def gate_report(rescue: DataFrame, links: DataFrame) -> DataFrame:
    """``dense_rank, pairs, true, kept``: pairs up to a rank, and the share of all true ones among them."""
    d = rescue.join(links.select("tid", "s1", F.lit(1).alias("y")), ["tid", "s1"], "left")
    g = d.groupBy("dense_rank").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("t"))
    up, every = Window.orderBy("dense_rank").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    true = F.sum("t").over(up)
    return g.select("dense_rank", F.sum("n").over(up).alias("pairs"), true.alias("true"), (true / F.greatest(F.sum("t").over(every), F.lit(1))).alias("kept"))


def merge_rescue(pred: DataFrame, rescue: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """``pred`` and the rescue pairs (tid, s1, country, p), but for countries that opt out."""
    return pred.select("tid", "s1", "country", "p").unionByName(rescue.where(~F.col("country").isin(*without) if without else F.lit(True)).select("tid", "s1", "country", "p"))


def widen(best: DataFrame, held: DataFrame, used: DataFrame, pool: DataFrame, scored: DataFrame, near: DataFrame, least_p: float = MIN_P, below: float = WIDE_P, share: float = WIDE_SHARE, seed: int = 42) -> DataFrame:
    """``tid, part``: targets that a simulation would miss, though the rescue lane is for them.

    Part B: targets of ``pool`` (tid, the second half) without a pair in play, at the rate at which ``scored`` (tid) was drawn from those with one. Part val: other targets
    whose best probability is under ``below``, a ``share`` of them by hash, if one of their nearest records (``near``: tid, s1; none dropped) is held out (``held``: s1).
    ``best`` is tid, p1 (the best probability); targets in ``used`` (tid) are never added. Draws are by hash of the id.
    """
    half = best.join(pool.select("tid").distinct(), "tid", "left_semi")
    rate = half.where(F.col("p1") >= least_p).agg(F.count(F.lit(1)).alias("__n")).crossJoin(scored.select("tid").distinct().agg(F.count(F.lit(1)).alias("__b")))  # one row
    quiet = half.where(F.col("p1") < least_p).join(used.select("tid"), "tid", "left_anti").crossJoin(F.broadcast(rate))
    quiet = quiet.where(unit("tid", seed + 300) * F.col("__n") < F.col("__b")).select("tid")
    rest = best.where(F.col("p1") < below).join(used.select("tid"), "tid", "left_anti").join(scored.select("tid"), "tid", "left_anti").join(quiet, "tid", "left_anti").where(unit("tid", seed + 400) < share)
    touching = near.join(held.select("s1"), "s1", "left_semi").select("tid").distinct()
    return rest.join(touching, "tid", "left_semi").select("tid", F.lit("val").alias("part")).unionByName(quiet.select("tid", F.lit("B").alias("part")))
