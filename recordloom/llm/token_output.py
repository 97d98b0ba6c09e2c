"""Operator 9: token ids as Parquet list columns, in ascending document order.

The file format: one Parquet folder, whose part files follow each other in
ascending order of (id, text). Each row has ``part`` (the part's number),
``doc_id``, ``local_start`` (ids before it in its part), ``n_tokens`` and
``tokens`` (list of int). Ids take dictionary encoding, so that a 50 k
vocabulary costs 16 bits or fewer an id; the ascending number columns take
delta encoding. Row groups and pages are small and carry page indexes, so a reader
that wants a document range, or only the counts, skips all other pages.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Bytes of a row group and of a page, and rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2000
#: How each column is encoded: v2 pages give delta encoding to number columns without a dictionary.
FORMAT = {
    "compression": "snappy",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text (null: empty), appends ``end_id``, and writes the format above to ``path``.

    One exchange: a range partition by (id, text hash, row), so that many rows with one
    id still spread. Rows with a null id come first. Other columns aren't read. An empty table gives an
    empty folder with the schema.
    """
    common.small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("text"))
    d = d.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    d = d.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")

    def encode(batches):
        import numpy as np
        from pyspark import TaskContext

        part, at, encoder = TaskContext.get().partitionId(), 0, tokens.ids_encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            got = [x + end for x in encoder.batch(b.column(1).to_pylist())]
            sizes = np.array([len(x) // 4 for x in got], "i8")
            ends = np.cumsum(sizes)
            ids = np.frombuffer(b"".join(got), "<u4").astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype("i4")), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), part, "i4")), b.column(0), pa.array(at + ends - sizes), pa.array(sizes), lists], ["part", "doc_id", "local_start", "n_tokens", "tokens"])
            at += int(ends[-1]) if len(ends) else 0

    d.mapInArrow(encode, SCHEMA).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, tokens`` as the files have them; ``start`` counts the ids of all documents before it.

    The parts' totals come from a read of two number columns; they are one row for each part.
    """
    return with_starts(spark.read.schema(SCHEMA).parquet(path))


def with_starts(rows: DataFrame) -> DataFrame:
    """The rows of the files, with starts, as read_tokens() gives them."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    offsets = totals.select("part", before.alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def digests(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of read_tokens()'s rows."""

    def crc(batches):
        import numpy as np

        for b in batches:
            lists = b.column(3)
            ids, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.array(sums, "i8"))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.work_dir(spark)
    write_tokens(common.read(spark, sf_dir, "documents"), path, tokens.public_path("byte_bpe_50k.json"))
    return digests(with_starts(common.read_work(spark, path, SCHEMA)))
