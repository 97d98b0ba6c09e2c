"""Connected components of a graph of links, by alternating stars; nothing of it is on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that a task of a round takes at least, and tasks that a round has at least, where the session has as many partitions.
EDGES, TASKS = 1 << 16, 8


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour (or itself). A hub's neighbours are dealt to several tasks."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stars = common.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")).coalesce(tasks))
    moved = common.spread_join(both.where("b > a"), stars.select("a", "m"), ["a"], stars).coalesce(tasks)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them. Rows have a > b."""
    stars = common.materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(tasks))
    moved = common.spread_join(edges, stars.select("a", "m"), ["a"], stars).where("b > m").coalesce(tasks)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(stars.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``edges`` (columns a, b, in any order): the smallest node reachable.

    Rounds go on until no edge changes, about the logarithm of the longest chain; each is written, so a lost executor
    costs at most one round. A round's tasks follow from the number of edges and not from the session's partitions, as small rounds would be nearly all overhead.
    """
    spark = edges.sparkSession
    now = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, tasks = None, max(TASKS, -(-now.count() // EDGES))
    for _ in range(most_rounds):
        large = common.materialize(_large_star(now, tasks))
        new = common.materialize(_small_star(large, tasks))
        common.discard(spark, now, large)
        now = new
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
