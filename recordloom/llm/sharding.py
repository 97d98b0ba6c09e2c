"""Operator 7: sharding by histogram sort, in DataFrame functions only.

Rows are ordered by a key: the hash of the text, so that equal texts are neighbours, then the hash of the row's
id, then the row's own number. Splitters are found without a sort: each round counts the exact bytes between probes, in one pass over narrow
written keys with sums before the exchange, and places new probes in the interval that holds each target,
until the bytes below every splitter are within the tolerance. Where all bytes of an interval are of one text, the
second part of the key splits its copies, and where they are of one id too, the third. Then the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Probes for each splitter and round.
PROBES = 256
#: Bytes below a splitter may miss its target by this share of a shard.
TOLERANCE = 0.001
#: Copies of one text are split between shards only where the better end of their group misses the target by more than this share.
GROUP_TOLERANCE = 0.01
#: Keys are hashes without their two lowest bits, so that sums and differences of them fit a long.
KEYS = 1 << 62


def hash62(*cols: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


@dataclass
class Splitter:
    """A boundary below which ``target`` bytes are wanted. It lies in lo to hi, and below and above are the bytes below these."""

    target: float
    above: int
    lo: int = 0
    hi: int = KEYS
    below: int = 0
    rows: int | None = None
    second: Splitter | None = None

    def nearest(self) -> tuple[int, float]:
        """The better end of the interval, and how far its bytes are from the target."""
        return min((self.lo, abs(self.below - self.target)), (self.hi, abs(self.above - self.target)), key=lambda x: x[1])


def _refine(keys: DataFrame, key: str, splitters: list[Splitter], tolerance: float, probes: int) -> None:
    """Narrows each splitter's interval until an end is within ``tolerance`` or one key has all its bytes."""
    while open_ := [s for s in splitters if s.nearest()[1] > tolerance and s.hi - s.lo > 1]:
        spans = sorted({(s.lo, s.hi) for s in open_})
        cell, span = F.lit(None).cast("long"), F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(spans):
            inside = (F.col(key) >= lo) & (F.col(key) < hi)
            span = F.when(inside, F.lit(i)).otherwise(span)
            cell = F.when(inside, F.expr(f"({key} - {lo}L) div {max(1, -(-(hi - lo) // probes))}L")).otherwise(cell)
        cells = keys.select(span.alias("span"), cell.alias("cell"), key, "size").where("span is not null").groupBy("span", "cell")
        counts = cells.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(key).alias("least"), F.max(key).alias("most"))
        by: dict[int, list] = {}
        for r in counts.collect():  # at most splitters x probes rows
            by.setdefault(r.span, []).append(r)
        for s in open_:
            below = s.below
            for r in sorted(by[spans.index((s.lo, s.hi))], key=lambda r: r.cell):
                if below + r.bytes >= s.target:
                    s.lo, s.hi, s.below, s.above, s.rows = r.least, r.most + 1, below, below + r.bytes, r.n
                    break
                below += r.bytes


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE, probes: int = PROBES) -> list[tuple[int, ...]]:
    """``shards - 1`` boundaries, ascending: a row is above one if (k1, k2, k3) >= it."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    if not total:
        return [(0, 0, 0)] * (shards - 1)
    near, group = tolerance * total / shards, group_tolerance * total / shards
    first = [Splitter(total * i / shards, total) for i in range(1, shards)]
    _refine(keys, "k1", first, near, probes)
    level = [((), s) for s in first]
    for deeper in ("k2", "k3"):
        inside: dict[tuple, list[Splitter]] = {}
        for prefix, s in level:
            if s.rows and s.rows > 1 and s.hi - s.lo == 1 and s.nearest()[1] > group:
                s.second = Splitter(s.target, s.above, below=s.below)
                inside.setdefault((*prefix, s.lo), []).append(s.second)
        for prefix, some in inside.items():  # fewer than shards
            same = F.lit(True)
            for k, x in zip(("k1", "k2"), prefix, strict=False):
                same = same & (F.col(k) == x)
            _refine(keys.where(same), deeper, some, near, probes)
        level = [(prefix, s) for prefix, some in inside.items() for s in some]

    def bound(s: Splitter) -> tuple[int, ...]:
        return (s.lo, *bound(s.second)) if s.second else (s.nearest()[0],)

    return sorted((*bound(s), 0, 0)[:3] for s in first)


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: shards of near equal bytes, slots gapless from 0 in each.

    A null text has size 1 and the checksum of an empty one. Equal texts share a shard unless a splitter falls among
    them and neither end of their group is near its target; so may equal rows, and rows without an id. Within a shard, slots follow parts of the keys'
    hashes, so that a shard, or a text that a third of all rows have, is numbered by many tasks. Equal rows
    are interchangeable; ids may be null; other columns aren't read; an empty table gives an empty result.
    """
    text = F.col(text_col)
    keys = docs.select(
        F.col(id_col).alias("doc_id"), hash62(common.text_of(text_col), text.isNull()).alias("k1"), hash62(F.col(id_col), F.lit(7)).alias("k2"), hash62(F.monotonically_increasing_id()).alias("k3"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(common.text_of(text_col).cast("binary")).alias("text_crc32"),
    )
    keys = common.materialize(keys)
    bounds = find_splitters(keys, shards, tolerance)
    shard = F.lit(0)
    for first, second, third in bounds:
        above = (F.col("k2") > second) | ((F.col("k2") == second) & (F.col("k3") >= third))
        shard = shard + ((F.col("k1") > first) | ((F.col("k1") == first) & above)).cast("int")
    parts = common.salt_count(keys.count())
    d = keys.withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64("k2", "k3"), F.lit(parts)))
    sums = d.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    base = sums.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("k1", "k2", "k3"))
    d = d.withColumn("in", within).join(base, ["shard", "part"])
    return d.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("in") - 1).cast("long").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(common.read(spark, sf_dir, "documents"))
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
