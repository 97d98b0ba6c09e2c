"""Operator 6: token counts by a two-tier lookup on the map side; pre-tokens are never shuffled.

Tier one is a compact table of the corpus's frequent pre-tokens and their numbers of ids. Each
partition keeps a bounded summary of its pre-token counts over all its texts; the summaries'
sums name the table's entries. The table only speeds things up: tier two, a worker's cache, has the
library encode whatever tier one lacks.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Entries of the broadcast table, entries that a partition's summary sends, and entries that it holds at most.
TABLE, SENT, HELD = 32_768, 4_096, 200_000


def frequent_pretokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", table: int = TABLE) -> list[str]:
    """The pre-tokens most frequent over all texts, ``table`` at most, by partition summaries of bounded size.

    A summary that outgrows HELD drops its smaller half, so an entry's count may be too small, never too large.
    Ties go to the smaller string.
    """
    kind = tokens.kind_of(tokenizer_path)

    def summarise(batches):
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(tokens.pre_tokens(t, kind) or ())
            if len(held) > HELD:
                held = Counter(dict(held.most_common(HELD // 2)))
        top = [(w, n) for w, n in held.most_common(SENT) if len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["w", "n"])

    rows = docs.select(common.text_of(text_col).alias("t")).mapInArrow(summarise, "w string, n long")
    top = rows.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(table)
    return [r.w for r in top.select("w").toLocalIterator()]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, in no exchange but the summaries'.

    A null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows; ids may be null; other
    columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    words = frequent_pretokens(docs, tokenizer_path, text_col, table)
    lengths = [len(e.ids) for e in tokens.tokenizer(tokenizer_path).encode_batch(words, add_special_tokens=False)]
    # at most TABLE strings of 64 characters: some hundred KB, whatever the input
    compact = spark.sparkContext.broadcast(("\0".join(words), bytes(min(n, 255) for n in lengths)))

    tier = uuid.uuid4().hex

    def count(batches):
        import numpy as np

        joined, sizes = compact.value
        first = lambda: {w: n for w, n in zip(joined.split("\0"), sizes, strict=False) if n < 255}
        encoder = tokens.count_encoder(tokenizer_path, tier, first)
        for b in batches:
            n = pa.array(np.array(encoder.batch(b.column(2).to_pylist()), "i8"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    text = common.text_of(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return d.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.read(spark, sf_dir, "documents"), tokens.public_path("byte_bpe_50k.json"))
