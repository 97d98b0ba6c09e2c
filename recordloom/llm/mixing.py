"""Operator 8: mixing sources to target weights, in DataFrame functions only.

Each source is a stream of words: its documents one after the other, in an order of hashes. The stream is cut
into blocks of ``block`` words. A source's target gives it a number of slots in the mix. How many of them each output
shard has is drawn: a source's counts over the shards are multinomial, given its total, which stays exact, so no source misses its
target by chance and none is repeated too often. The counts lay the slots out: a shard has a run of each source's slots. A slot's number gives
an epoch and an index, and a pseudorandom permutation of the source's indices for that epoch gives the
block. Blocks and slots are joined by (source, index); both are spread over all tasks, however large a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 64
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Slots of one output shard, on average.
SHARD_SLOTS = 1 << 14
#: Rounds of a permutation; indices of a source at most.
ROUNDS, MOST_BLOCKS = 32, 1 << 40
#: Slots that one task makes, about: they come of a few narrow rows, whose bytes don't tell.
TASK_SLOTS = 1 << 15
#: Slots, or shards, that are handled as one row or window.
CHUNK = 4096


def with_targets(keys: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, block: int = BLOCK) -> DataFrame:
    """One row for each source: ``source, source_size, weight, target, n_blocks, n_slots``.

    Sources go by code point, null last; their weights repeat. Targets share all sizes by weight. A target stops at
    ``most`` times its source's size, and the others share what is left by weight, until none is above. Closed form: with
    sources in order of most x size / weight, a source stops if it is at or below the level that would be left without the
    ones before it; the level of the first that doesn't stop is that of all others. The windows run over sources, not documents.
    """
    s = keys.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    cap = (F.col("source_size") * most).cast("double")
    before = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / share).withColumn("stops", cap <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    s = s.withColumn("target", F.when(F.col("stops"), cap).otherwise(level * F.col("weight")))
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    s = s.withColumn("n_blocks", n_blocks)
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0.0)
    s = s.withColumn("n_slots", F.least(slots.cast("long"), F.col("n_blocks") * most))
    fits = F.assert_true(F.col("n_blocks") < MOST_BLOCKS, F.lit("a source has too many blocks: take a larger block"))
    return s.where(fits.isNull()).drop("level", "stops")


def round_keys(n: Column, source: Column, seed: int) -> Column:
    """For each round of a source's permutation of 0 to n - 1: the sum of the places that it may exchange, and a salt."""
    keyed = lambda r: F.struct(F.pmod(F.xxhash64(source, F.lit(seed), r), n).alias("sum"), F.xxhash64(source, F.lit(seed), r, F.lit(1)).alias("salt"))
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), keyed)


def permuted(i: Column, n: Column, keys: Column, epoch: Column) -> Column:
    """The place of index i in the permutation of 0 to n - 1 by ``keys`` (see round_keys()) and epoch.

    Swap or not: in each round, two places whose sum is the round's change places or stay, by a hash of the larger. Every round is a
    permutation of exactly 0 to n - 1, whatever n is, and neighbours go separate ways.
    """

    def swap_or_not(x: Column, key: Column) -> Column:
        other = F.pmod(key["sum"] - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), epoch, key["salt"]).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(keys, i.cast("long"), swap_or_not)


def tasks(sources: DataFrame) -> int:
    """Tasks for the slots of ``sources``, a small written table."""
    slots = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    return int(min(1 << 16, max(8, -(-slots // TASK_SLOTS))))


def draw_counts(sources: DataFrame, seed: int = 42, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``source, n_blocks, shard, count, first``: the slots of each source that each shard has, drawn, and the slots of shards before it.

    Each of a source's slots falls on a shard by a uniform draw, so its counts are multinomial. ``sources`` has the rows of with_targets().
    """
    n = tasks(sources)
    d = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("n_slots").over(Window.partitionBy()) / shard_slots)).cast("long")).where("n_slots > 0")
    d = d.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / CHUNK).cast("long")))).repartition(n, "source", "chunk")
    d = d.withColumn("ball", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("chunk") * CHUNK + CHUNK, F.col("n_slots")) - 1)))
    counts = d.select("source", "n_blocks", F.pmod(F.xxhash64("source", "ball", F.lit(seed)), F.col("shards")).alias("shard"))
    counts = counts.groupBy("source", "n_blocks", "shard").agg(F.count(F.lit(1)).alias("count")).withColumn("part", F.floor(F.col("shard") / CHUNK))
    sums = counts.groupBy("source", "part").agg(F.sum("count").alias("__n"))
    base = sums.select(F.col("source").alias("__s"), F.col("part").alias("__p"), (F.sum("__n").over(Window.partitionBy("source").orderBy("part")) - F.col("__n")).alias("__base"))
    within = F.sum("count").over(Window.partitionBy("source", "part").orderBy("shard")) - F.col("count")
    counts = counts.withColumn("__in", within).join(base, F.col("source").eqNullSafe(F.col("__s")) & (F.col("part") == F.col("__p")))
    return counts.select("source", "n_blocks", "shard", "count", (F.col("__base") + F.col("__in")).alias("first"))


def draw_slots(sources: DataFrame, seed: int = 42, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``shard, source, slot, epoch, block``: all slots of the mix, as draw_counts() lays them out."""
    d = draw_counts(sources, seed, shard_slots).repartition(tasks(sources), "source", "shard").withColumn("__keys", round_keys(F.col("n_blocks"), F.col("source"), seed))
    d = d.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    d = d.withColumn("epoch", F.floor(F.col("slot") / F.col("n_blocks")).cast("long"))
    index = F.col("slot") - F.col("epoch") * F.col("n_blocks")
    return d.select("shard", "source", "slot", "epoch", permuted(index, F.col("n_blocks"), F.col("__keys"), F.col("epoch")).alias("block"))


def cut_blocks(keys: DataFrame, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """``uid, source, block, first, words``: which words of which document each block of its source's stream has.

    Documents of a source are ordered by (part, hash); the parts' sums give where each part begins, so that no task has
    to hold a source. A document without words is in no block.
    """
    parts = common.salt_count(keys.count())
    d = keys.where("size > 0").withColumn("__h", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("part", F.pmod("__h", F.lit(parts)))
    sums = d.groupBy("source", "part").agg(F.sum("size").alias("__n"))
    base = sums.select(F.col("source").alias("__s"), F.col("part").alias("__p"), (F.sum("__n").over(Window.partitionBy("source").orderBy("part")) - F.col("__n")).alias("__base"))
    within = F.sum("size").over(Window.partitionBy("source", "part").orderBy("__h", "uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    d = d.withColumn("__in", within).join(base, F.col("source").eqNullSafe(F.col("__s")) & (F.col("part") == F.col("__p")))
    start = F.col("__base") + F.col("__in")
    d = d.select("uid", "source", "size", start.alias("start"))
    end = F.col("start") + F.col("size")
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((end - 1) / block).cast("long"))))
    first = F.greatest(F.col("start"), F.col("block") * block)
    return d.select("uid", "source", "block", (first - F.col("start")).alias("first"), (F.least(end, (F.col("block") + 1) * block) - first).alias("words"))


def same_block(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"]) & (a["block"] == b["block"])


def keys_of(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``uid, doc_id, source, size``, written: a row number that stays the same, and the words of the text (null: none)."""
    return common.materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), common.n_words(common.text_of(text_col)).alias("size")))


def taken_words(keys: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, block: int = BLOCK, seed: int = 42, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_shard, last_shard`` for each row of ``keys``.

    The shards are the first and the last that has words of the document, null if none has.
    Rows whose source is null are a source; documents without words and sources without words take none; repeated rows
    are documents of their own. An empty table gives an empty result. A rerun over the same rows draws the same mix.
    """
    sources = common.materialize(with_targets(keys, weights, most, block))
    copies = draw_slots(sources, seed, shard_slots).groupBy("source", "block").agg(F.count(F.lit(1)).alias("copies"), F.min("shard").alias("lo"), F.max("shard").alias("hi"))
    pieces = cut_blocks(keys, block, seed)
    # slots come of a few rows by explode, which Spark takes for a small table: without the hint it would broadcast them all
    taken = pieces.join(copies.hint("merge"), same_block(pieces, copies), "left").groupBy(pieces["uid"]).agg(F.sum(F.coalesce(F.col("words") * F.col("copies"), F.lit(0))).alias("taken"), F.min("lo").alias("first_shard"), F.max("hi").alias("last_shard"))
    with_size = keys.join(sources, keys["source"].eqNullSafe(sources["source"]))
    rows = with_size.select("uid", "doc_id", "size", "source_size", "target")
    return rows.join(taken, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """The mix as rows of ``docs``, all columns: for each document and epoch, the part of its text that the mix takes.

    A text taken whole stays as it is. Of others, each taken stretch keeps its own white space, and stretches are joined by line
    ends. A document of which nothing is taken (among them null, empty and blank texts) has no row; one that is repeated has up to ``most``.
    Rows whose source is null are a source; ids and other columns may be null; repeated rows are documents of their own; an empty table gives
    an empty result.
    """
    d = common.with_row(docs)
    keys = common.materialize(d.select(F.col("__row").alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), common.n_words(common.text_of(text_col)).alias("size")))
    sources = common.materialize(with_targets(keys, weights, most, block))
    slots, pieces = draw_slots(sources, seed), cut_blocks(keys, block, seed)
    taken = pieces.join(slots.hint("merge"), same_block(pieces, slots)).select("uid", "epoch", "first", "words")
    # the pieces of one document
    runs = taken.groupBy("uid", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("__runs"), F.sum("words").alias("__taken"))
    d = d.join(runs.withColumnRenamed("uid", "__row"), "__row").withColumn("__words", F.regexp_extract_all(F.col(text_col), F.lit(rf"{common.WORD}[{common.SPACE}]*"), F.lit(0)))
    whole = F.col("__taken") == F.size("__words")
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    last = lambda a: F.element_at(a, -1)
    more = lambda a, r: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["first"].alias("first"), (r["first"] + r["words"]).alias("end"))))
    new = lambda a, r: F.concat(a, F.array(F.struct(r["first"].alias("first"), (r["first"] + r["words"]).alias("end"))))
    merged = F.aggregate("__runs", none, lambda a, r: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] == r["first"]), more(a, r)).otherwise(new(a, r)))
    d = d.withColumn("__stretches", F.when(whole, none).otherwise(merged))
    part = F.array_join(F.transform("__stretches", lambda r: F.rtrim(F.array_join(F.slice("__words", r["first"].cast("int") + 1, (r["end"] - r["first"]).cast("int")), ""))), "\n")
    return d.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(part)).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(keys_of(common.read(spark, sf_dir, "documents")))
