"""All pairs of two sides within a group, with a similarity: blocks of names meet as tables, and no pair is a row before it is a result."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.similarity import jaro_winkler_table
from recordloom.session import ship_package

#: Rows of a block, about; pairs of a task, about, and tasks at most.
BLOCK, TASK, TASKS = 1 << 10, 1 << 22, 1 << 16


def _blocks(side: DataFrame, name: str) -> DataFrame:
    """``group, <name>_block, <name>_part, <name>``: the rows ``key, name`` of each group in blocks. Equal names are in one block, or in parts of it."""
    many = side.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    d = side.join(many, "group").select("group", "key", "name", F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / BLOCK)).alias("block"))
    many = d.groupBy("group", "block").agg(F.count(F.lit(1)).alias("n"))
    d = d.join(many, ["group", "block"]).withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / (2 * BLOCK))))
    return d.groupBy("group", "block", "part").agg(F.collect_list(F.struct("key", "name")).alias(name)).withColumnsRenamed({"block": f"{name}_block", "part": f"{name}_part"})


def jaro_winkler_pairs(left: DataFrame, right: DataFrame, digits: int) -> DataFrame:
    """``a, b, jw``: the keys of every left and right row of the same group and the Jaro-Winkler similarity of their names to so many digits.

    Sides are ``group, key`` (long), ``name``. Rows without a group take no part; a null name gives null. Repeated rows stay. Each distinct pair of names of two blocks
    is compared once.
    """
    spark = left.sparkSession
    ship_package(spark)
    left, right = (d.where("group is not null") for d in (left, right))
    sizes = left.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(right.groupBy("group").agg(F.count(F.lit(1)).alias("m")), "group")
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    tables = _blocks(left, "a").join(_blocks(right, "b"), "group")
    tables = tables.repartition(int(min(TASKS, max(1, pairs // TASK))), "group", "a_block", "a_part", "b_block", "b_part").select("a", "b")

    def compare(batches):
        import numpy as np

        def side(rows):
            names = sorted({r["name"] for r in rows if r["name"] is not None})
            number = {x: i for i, x in enumerate(names)}
            return pa.array([r["key"] for r in rows], pa.int64()), names, np.array([number.get(r["name"], -1) for r in rows], "i8")

        for batch in batches:
            for i in range(batch.num_rows):
                (a, a_names, a_number), (b, b_names, b_number) = side(batch.column(0)[i].as_py()), side(batch.column(1)[i].as_py())
                # a row and a column more, of nulls, for number -1
                table = np.full((len(a_names) + 1, len(b_names) + 1), np.nan)
                table[:-1, :-1] = jaro_winkler_table(a_names, b_names, digits)
                step = max(1, (1 << 17) // len(b))
                for at in range(0, len(a), step):
                    part = a_number[at : at + step]
                    jw = table[part[:, None], b_number[None, :]].ravel()
                    key = a.take(pa.array(np.repeat(np.arange(at, at + len(part)), len(b))))
                    other = b.take(pa.array(np.tile(np.arange(len(b)), len(part))))
                    yield pa.RecordBatch.from_arrays([key, other, pa.array(jw, mask=np.isnan(jw))], ["a", "b", "jw"])

    return tables.mapInArrow(compare, "a long, b long, jw double")
