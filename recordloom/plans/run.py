"""A run over files: fit once, predict, write the lists. Stages that an earlier run finished are read and not made again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.functions.text import normalize_records
from recordloom.sources import sinks, tables, validate

from .resolver import Resolver, Scorer


def records_of(spark: SparkSession, layout: tables.Layout, split: str) -> tuple[DataFrame, DataFrame]:
    """(reference, targets) of a split: source 1, and sources 2 and 3, written once as Parquet by country."""
    made = lambda name, make: sinks.stage(spark, layout.work_file(split, name), make, ("country",)).select(*tables.RECORD_COLUMNS)
    reference = made("reference", lambda: tables.read_records(spark, layout.source(split, 1)))
    return reference, made("targets", lambda: tables.read_targets(spark, layout.source(split, 2), layout.source(split, 3)))


def fitted(spark: SparkSession, layout: tables.Layout, split: str = "train", scorer: Scorer | None = None, **options) -> Resolver:
    """The resolver of a split with truth, fitted and saved, or loaded."""
    path = layout.work_file(split, "resolver")
    if not sinks.exists(spark, f"{path}/state.json"):
        reference, targets = records_of(spark, layout, split)
        truth = tables.read_tsv(spark, layout.truth(split))
        Resolver(scorer=scorer, **options).fit(reference, targets, tables.truth_links(truth)).save(spark, path)
    return Resolver.load(spark, path, scorer)


def run(spark: SparkSession, layout: tables.Layout, train: str = "train", split: str = "test", scorer: Scorer | None = None, overrides: dict[str, float] | None = None, **options) -> DataFrame:
    """Writes both result tables of ``split`` and their archive below ``layout.output``; returns the validator's findings."""
    resolver = fitted(spark, layout, train, scorer, **options)
    reference, targets = records_of(spark, layout, split)
    pred = sinks.stage(spark, layout.work_file(split, "predictions"), lambda: resolver.predict(reference, targets))
    lists = sinks.stage(spark, layout.work_file(split, "lists"), lambda: resolver.lists(pred, overrides))
    found = sinks.stage(spark, layout.work_file(split, "candidates"), lambda: pred.groupBy("s1").agg({"tid": "collect_list"}).toDF("s1", "tids"))
    out = {"matched_entity_ids": f"{layout.output}/matching.tsv", "candidate_entity_ids": f"{layout.output}/candidates.tsv"}
    for (column, path), d in zip(out.items(), (lists, found), strict=True):
        sinks.write_tsv(sinks.id_lists(reference, d, column), path)
    sinks.write_zip(spark, {path.rsplit("/", 1)[1]: path for path in out.values()}, f"{layout.output}/results.zip")
    return validate.validate(spark, out["matched_entity_ids"], out["candidate_entity_ids"], reference, targets)


def normalized(spark: SparkSession, layout: tables.Layout, split: str) -> tuple[DataFrame, DataFrame]:
    """(reference, targets), normalized and written once by country."""
    sides = zip(("reference", "targets"), records_of(spark, layout, split), strict=True)
    a, b = (sinks.stage(spark, layout.work_file(split, f"{name}_normalized"), lambda d=d: normalize_records(d), ("country",)) for name, d in sides)
    return a, b
