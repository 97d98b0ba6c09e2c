from pyspark.sql import functions as F
from recordloom import session
from recordloom.llm import common, components


def test_rounds_of_few_edges_are_few_tasks(spark):
    """Whatever number of partitions the session has: with 211, as on check_h, rounds wrote a file for each."""
    edges = common.materialize(spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    with session.settings(spark, spark__sql__shuffle__partitions="50", spark__sql__adaptive__coalescePartitions__enabled="false"):
        roots = components.components(edges)
        assert len(roots.inputFiles()) <= components.TASKS and {r.root for r in roots.collect()} == {0} and roots.count() == 501
