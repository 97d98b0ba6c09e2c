"""The whole resolution: fit on records with truth, save, load, apply to others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import normalize_records
from recordloom.operators import assignment, blocking, group_features, metrics, pair_features, rescue, splits
from recordloom.session import materialize
from recordloom.sources import sinks, tables

from . import models

#: (pairs, raw reference, raw targets) -> tid, s1, ce
Scorer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
#: (target vectors, reference vectors): entity_id, country, embedding
Vectors = tuple[DataFrame, DataFrame]


@dataclass
class Resolver:
    """Links target records to reference records. Records are entity_id, business_name, business_address, country.

    fit() learns the prefilter, the stages and the decision rule; predict() gives probabilities, and resolve() lists. Each stage
    is written to the shared work folder, so that no plan holds the ones before it and a lost executor costs one stage.

    With a ``scorer``, stage 2 also has the pair score's standing, address crowding and name weights. With vectors, targets without a good pair
    get their nearest records in a third, the rescue stage, which needs the scorer's scores, too.
    """

    prefilter: dict | None = None
    stage1: PipelineModel | None = None
    stage2: PipelineModel | None = None
    rescuer: PipelineModel | None = None
    decision: dict = field(default_factory=lambda: {"threshold": 0.5, "expected_f": True})
    rounds: int = 40
    seen: DataFrame | None = None
    scorer: Scorer | None = None

    def candidates(self, reference: DataFrame, targets: DataFrame) -> DataFrame:
        """Ranked candidates with context; normalized records in."""
        pairs = blocking.cheap_similarities(blocking.retrieve(reference, targets), reference, targets)
        return pair_features.with_context(blocking.rank_candidates(pairs, self.prefilter))

    def _features(self, cands: DataFrame, reference: DataFrame, targets: DataFrame) -> DataFrame:
        return pair_features.pair_features(cands, reference, targets).withColumnRenamed("t_country", "country")

    @property
    def group_columns(self) -> tuple[str, ...]:
        return (*group_features.GROUP_FEATURES, *(group_features.SCORE_FEATURES + group_features.NAME_FEATURES if self.scorer else ()))

    def _group(self, pred: DataFrame, ref: DataFrame, tgt: DataFrame, reference: DataFrame, targets: DataFrame) -> DataFrame:
        d = group_features.group_features(pred, ref, tgt)
        if self.scorer:
            d = materialize(d)
            scores = materialize(self.scorer(d.select("tid", "s1"), reference, targets))
            d = group_features.add_name_weights(group_features.add_scores(d, scores, ref, tgt), ref, tgt)
        return d

    def _rescue(self, pred: DataFrame, ref: DataFrame, tgt: DataFrame, reference: DataFrame, targets: DataFrame, vectors: Vectors) -> DataFrame:
        d = materialize(rescue.rescue_candidates(pred, pred, *vectors, tgt, ref))
        return rescue.rescue_features(d, materialize(self.scorer(d.select("tid", "s1"), reference, targets)))

    def fit(self, reference: DataFrame, targets: DataFrame, links: DataFrame, vectors: Vectors | None = None) -> Resolver:
        """``links`` are tid, s1. Stage 2 learns from out-of-fold scores of stage 1, the rescue stage from those of stage 2."""
        if vectors and not self.scorer:
            raise ValueError("the rescue stage needs a scorer")
        ref, tgt = materialize(normalize_records(reference)), materialize(normalize_records(targets))
        y = links.select("tid", "s1", F.lit(1.0).alias("y"))
        pairs = materialize(blocking.cheap_similarities(blocking.retrieve(ref, tgt), ref, tgt))
        self.prefilter = blocking.fit_prefilter(pairs, links)
        cands = pair_features.with_context(blocking.rank_candidates(pairs, self.prefilter))
        label = lambda d: d.join(y, ["tid", "s1"], "left").fillna(0.0, subset=["y"])
        feats = materialize(label(self._features(cands, ref, tgt)))
        self.stage1 = models.fit(feats, pair_features.FEATURES, rounds=self.rounds)
        pred = materialize(models.out_of_fold(feats, pair_features.FEATURES, rounds=self.rounds))
        group = materialize(label(self._group(pred, ref, tgt, reference, targets)))
        self.stage2 = models.fit(group, self.group_columns, rounds=self.rounds)
        second = materialize(models.out_of_fold(group, self.group_columns, rounds=self.rounds).withColumnRenamed("p", "p2"))
        pred = materialize(group_features.rescore(pred, second))
        if vectors:
            found = materialize(label(self._rescue(pred, ref, tgt, reference, targets, vectors)))
            if found.where("y > 0").isEmpty() or found.where("y = 0").isEmpty():
                self.rescuer = None  # nothing to learn: all or none of them are true
            else:
                self.rescuer = models.fit(found, rescue.RESCUE_FEATURES, rounds=self.rounds)
                pred = materialize(rescue.merge_rescue(pred, models.out_of_fold(found, rescue.RESCUE_FEATURES, rounds=self.rounds)))
        none = F.array().cast("array<string>")
        truth = ref.select(F.col("entity_id").alias("s1")).join(links.groupBy("s1").agg(F.collect_list("tid").alias("tids")), "s1", "left").select("s1", F.coalesce("tids", none).alias("tids"))
        self.decision, self.grid = metrics.tune(pred, materialize(truth))
        self.seen = materialize(ref.select("country").distinct())
        return self

    def predict(self, reference: DataFrame, targets: DataFrame, vectors: Vectors | None = None, without: tuple[str, ...] = ()) -> DataFrame:
        """``tid, s1, country, p``. Countries in ``without`` get no rescued pairs."""
        ref, tgt = materialize(normalize_records(reference)), materialize(normalize_records(targets))
        pred = materialize(models.predict(self.stage1, self._features(self.candidates(ref, tgt), ref, tgt), pair_features.FEATURES))
        if self.stage2 is not None:
            group = self._group(pred, ref, tgt, reference, targets)
            pred = materialize(group_features.rescore(pred, models.predict(self.stage2, group, self.group_columns, "p2", ("tid", "s1"))))
        if vectors and self.rescuer is not None:
            found = self._rescue(pred, ref, tgt, reference, targets, vectors)
            pred = rescue.merge_rescue(pred, models.predict(self.rescuer, found, rescue.RESCUE_FEATURES), without)
        return pred

    def resolve(self, reference: DataFrame, targets: DataFrame, overrides: dict[str, float] | None = None, vectors: Vectors | None = None, without: tuple[str, ...] = ()) -> DataFrame:
        """``s1, tids``: each record's targets."""
        return self.lists(materialize(self.predict(reference, targets, vectors, without)), overrides)

    def lists(self, pred: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
        """``s1, tids`` of written predictions, by the decision rule."""
        limits = assignment.country_thresholds(pred, self.decision["threshold"], self.seen, overrides)
        return assignment.assign_by_country(pred, limits, self.decision["expected_f"])

    def simulate_drop(self, cands: DataFrame, truth: DataFrame) -> DataFrame:
        """Candidates as if a share of the records were missing."""
        return pair_features.with_context(splits.without_dropped(cands.drop("s1_top1_count"), splits.dropped_records(truth)))

    def save(self, spark: SparkSession, path: str) -> None:
        """All that fit() learned, into a folder. The scorer is code and is given again to load()."""
        state = {"prefilter": self.prefilter, "decision": self.decision, "rounds": self.rounds, "scored": self.scorer is not None, "models": []}
        for name in ("stage1", "stage2", "rescuer"):
            if (model := getattr(self, name)) is not None:
                model.write().overwrite().save(f"{path}/{name}")
                state["models"].append(name)
        self.seen.write.mode("overwrite").parquet(f"{path}/seen")
        sinks.write_json(spark, state, f"{path}/state.json")  # last: a folder that has it is whole

    @classmethod
    def load(cls, spark: SparkSession, path: str, scorer: Scorer | None = None) -> Resolver:
        state = tables.read_json(spark, f"{path}/state.json")
        if state["scored"] != (scorer is not None):
            raise ValueError("this resolver was fitted " + ("with a scorer" if state["scored"] else "without a scorer"))
        found = {name: PipelineModel.load(f"{path}/{name}") for name in state["models"]}
        return cls(prefilter=state["prefilter"], decision=state["decision"], rounds=state["rounds"], seen=tables.read_parquet(spark, f"{path}/seen"), scorer=scorer, **found)
