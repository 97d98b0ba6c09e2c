"""Exact dense top-k by cosine within a country: blocks of the stated query set meet every reference record once."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import materialize, read_work, ship_package, work_dir

#: Targets that one pass over the reference takes along.
BLOCK = 8192
SCHEMA = "tid string, s1 string, country string, dense_cos double"


def _pass(reference: DataFrame, block: dict, k: int, exclude_same: bool) -> DataFrame:
    """Each task's best k for each target of a block: country -> (ids, matrix)."""
    shared = reference.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        import numpy as np

        held: dict = {}  # country -> (target number, -cosine, id), the best so far
        place = {c: {t: i for i, t in enumerate(ids)} for c, (ids, _) in shared.value.items()}
        for b in batches:
            countries, ids = np.array(b.column(1).to_pylist(), object), np.array(b.column(0).to_pylist(), object)
            for c in set(countries.tolist()) & set(place):
                rows = np.flatnonzero(countries == c)
                x = np.stack(b.column(2).take(pa.array(rows)).to_pylist()).astype("f8")
                cos = shared.value[c][1] @ x.T
                if exclude_same:
                    for j, i in enumerate(ids[rows]):
                        if i in place[c]:
                            cos[place[c][i], j] = -np.inf
                least = np.partition(cos, -k, axis=1)[:, -k] if cos.shape[1] > k else np.full(len(cos), -np.inf)
                t, j = np.nonzero((cos >= least[:, None]) & np.isfinite(cos))
                new = (t, -cos[t, j], ids[rows][j])
                every = [np.concatenate(x) for x in zip(held[c], new, strict=True)] if c in held else new
                order = np.lexsort((np.unique(every[2], return_inverse=True)[1], every[1], every[0]))
                every = [x[order] for x in every]
                rank = np.arange(len(order)) - np.searchsorted(every[0], every[0])
                held[c] = [x[rank < k] for x in every]
        for c, (t, cos, ids) in held.items():
            names = np.array(shared.value[c][0], object)[t]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.string()), pa.array([c] * len(t), pa.string()), pa.array(-cos)], ["tid", "s1", "country", "dense_cos"])

    return reference.mapInArrow(scan, SCHEMA)


def dense_top_k(targets: DataFrame, reference: DataFrame, k: int, id_col: str = "entity_id", vector_col: str = "embedding", exclude_same: bool = False) -> DataFrame:
    """``tid, s1, country, dense_cos, dense_rank``: each target's k nearest reference records of its country; ties go to the smaller s1.

    Exact. Targets are the stated query set: BLOCK of them at a time, chosen by hash, are broadcast, and one pass over the written reference gives each
    task's best k, so neither side is copied for the other. A record meets the targets of its own country only. ``exclude_same`` leaves out the record of
    the target's own id. Ids and vectors without nulls; records without a country take no part.
    """
    import numpy as np

    spark = targets.sparkSession
    ship_package(spark)
    side = lambda d: materialize(d.select(F.col(id_col).cast("string").alias("id"), F.col("country").cast("string"), F.col(vector_col).cast("array<float>").alias("v")).where("country is not null"))
    asked, rows = side(targets), side(reference)
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    path = work_dir(spark)
    best = Window.partitionBy("tid").orderBy(F.desc("dense_cos"), "s1")
    ranked = lambda d: d.withColumn("dense_rank", F.row_number().over(best)).where(F.col("dense_rank") <= k)
    for i in range(blocks):
        block: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect():  # about BLOCK rows
            block.setdefault(r.country, []).append((r.id, r.v))
        block = {c: ([t for t, _ in x], np.array([v for _, v in x], "f8")) for c, x in block.items()}
        found = ranked(_pass(rows, block, k, exclude_same))
        if blocks == 1:
            return found
        found.write.mode("append").parquet(path)
    return read_work(spark, path, f"{SCHEMA}, dense_rank int")


def solo(targets: DataFrame, reference: DataFrame, slope: float, intercept: float, k: int = 8, **columns) -> DataFrame:
    """``tid, s1, country, p``: vectors alone, without blocking or trees. Each target's k nearest records, by the logistic of a line of the cosine."""
    d = dense_top_k(targets, reference, k, **columns)
    return d.select("tid", "s1", "country", (1 / (1 + F.exp(-(F.lit(slope) * F.col("dense_cos") + F.lit(intercept))))).alias("p"))
