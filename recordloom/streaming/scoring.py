"""Extension: new targets arrive as a stream and are linked against a static reference, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def link_stream(targets: DataFrame, resolve: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of the stream goes through ``resolve`` and is written to ``path`` under its batch number.

    A batch that is run again after a failure replaces what it wrote before, so each target's links are written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        resolve(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = targets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
