"""Operator 1: shortest-pack-first packing over the length histogram.

1. Texts become ids and are cut into pieces of at most ``size`` ids (map side).
2. The histogram of piece lengths, at most ``size`` rows, goes to the driver, which packs lengths, not
   documents: the longest first, each into the emptiest packs that have room, updating the counts of packing patterns.
3. Each pattern takes a run of ranks of each of its lengths. A piece gets its rank among pieces of its
   length, and a binary search among the runs gives its sequence and place.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

SIZE = 4096
#: A run's key is its length times this, plus its first rank; so 2**44 pieces of a length fit.
RANKS = 1 << 44


def pack_histogram(histogram: dict[int, int], size: int) -> tuple[list[list[int]], int]:
    """Runs ``[length, first rank, pieces a sequence, first sequence, first offset]``, sorted, and the number of sequences.

    ``histogram`` maps a length (1 to ``size``) to its number of pieces. Lengths go longest first; pieces of one
    length go to the packs with the most room (the shortest packs), and where none has room, to new packs that
    each take as many as fit. Packs of equal content are one pattern with a count; a step splits at most one
    pattern, so there are at most about two for each length, however many pieces there are.
    """
    room: dict[int, list[list]] = defaultdict(list)  # free ids -> [count, content], content = (length, times, rest)
    heap: list[int] = []
    done: list[tuple[int, tuple]] = []

    def put(free: int, count: int, content: tuple) -> None:
        if count:
            if free:
                if not room[free]:
                    heapq.heappush(heap, -free)
                room[free].append([count, content])
            else:
                done.append((count, content))

    def add(content: tuple | None, length: int, times: int) -> tuple:
        if content and content[0] == length:
            return (length, content[1] + times, content[2])
        return (length, times, content)

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left and heap:
            free = -heap[0]
            if not room[free]:
                heapq.heappop(heap)
                continue
            if free < length:
                break
            count, content = room[free].pop()
            if not room[free]:
                heapq.heappop(heap)
            took = min(count, left)
            put(free, count - took, content)
            put(free - length, took, add(content, length, 1))
            left -= took
        each = size // length
        put(size - each * length, left // each, add(None, length, each))
        if left % each:
            put(size - left % each * length, 1, add(None, length, left % each))
    for free, groups in room.items():
        done.extend((count, content) for count, content in groups)

    used: dict[int, int] = defaultdict(int)
    runs, sequence = [], 0
    for count, content in done:
        items = []
        while content:
            items.append(content[:2])
            content = content[2]
        offset = 0
        for length, times in reversed(items):
            runs.append([length, used[length], times, sequence, offset])
            used[length] += times * count
            offset += length * times
        sequence += count
    return sorted(runs), sequence


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = SIZE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids and ``end_id``, cut into pieces: ``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``).

    A null or empty text is the end id alone. Ids may be null; other columns aren't read.
    """
    common.small_batches(docs.sparkSession)

    def cut(batches):
        import numpy as np

        encoder, end = tokens.ids_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, got in zip(b.column(0).to_pylist(), encoder.batch(b.column(1).to_pylist()), strict=True):
                got += end
                n = len(got) // 4
                for s in range(0, n, size):
                    x = got[4 * s : 4 * (s + size)]
                    rows.append((doc, s, len(x) // 4, zlib.crc32(x), n, x))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in cols[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, whose ``length`` is 1 to ``size``; all other columns stay.

    ``pieces`` needs ``doc_id, start, length`` and is read twice: give a written table. A length that a third of
    all pieces have is ranked in parts, by a hash of (doc_id, start). Equal rows are interchangeable; an empty
    table gives an empty result.
    """
    spark = pieces.sparkSession
    common.small_batches(spark)
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    runs, _ = pack_histogram(histogram, size)
    table = spark.sparkContext.broadcast(list(zip(*runs, strict=True)))  # bounded by patterns x lengths of a pattern

    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(common.salt_count(sum(histogram.values()))))
    salted = pieces.withColumn("__part", part)
    sums = salted.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")
    base = sums.select("length", "__part", before.alias("__base"))
    within = Window.partitionBy("length", "__part").orderBy("doc_id", "start")
    ranked = salted.withColumn("__in", F.row_number().over(within)).join(base, ["length", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__in") - 1).select(*pieces.columns, "__rank")
    at = pieces.columns.index("length")

    def place(batches):
        import numpy as np

        length, first, times, sequence, offset = (np.array(c, "i8") for c in table.value) if table.value else [np.zeros(0, "i8")] * 5
        keys = length * RANKS + first
        for b in batches:
            n = b.column(at).to_numpy()
            rank = b.column(b.num_columns - 1).to_numpy()
            i = np.searchsorted(keys, n * RANKS + rank, "right") - 1
            k = rank - first[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence[i] + k // times[i]), pa.array(offset[i] + k % times[i] * n)], [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return pack(common.materialize(tokenize_pieces(docs, tokens.public_path("word_bpe_49k.json"))))
