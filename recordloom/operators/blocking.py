"""Candidate generation: five key channels, weighted by inverse frequency, joined on (country, key)."""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.similarity import similarity
from recordloom.functions.text import let, words
from recordloom.session import materialize, ship_package

#: Keys and channels of the method.
TOP_K, FINAL_K, MAX_KEY_DF, MIN_COSINE, MAX_GRAM_SHARE = 10, 8, 200, 0.05, 0.002
CHANNELS = ("name_ngram", "phon_key", "mix_key", "name_key", "addr_key")
#: Sums of doubles depend on their order in the last digits; ranks don't look at them.
DIGITS = 9
PREFILTER_FEATURES = (*CHANNELS, "pf_name", "pf_addr")


def _pairs(a: Column, joint: str) -> Column:
    """Neighbours of an array, joined."""
    return F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(joint), y))


def _cross(a: Column, b: Column, joint: str) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit(joint), y))))


def _longer(a: Column, n: int) -> Column:
    return F.filter(a, lambda t: F.length(t) >= n)


def grams(text: Column, n: int = 4) -> Column:
    """Character n-grams of a text with a space at each end."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return let(F.regexp_replace(padded, r"\s\s+", " "), lambda p: F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substr(p, i, F.lit(n)))).otherwise(F.array(p)))


def name_keys(name: Column) -> Column:
    compact = F.replace(name, F.lit(" "), F.lit(""))
    start = F.when(F.length(compact) >= 6, F.array(F.concat(F.lit("P:"), F.substring(compact, 1, 6)))).otherwise(F.array().cast("array<string>"))
    return let(words(name), lambda w: F.concat(_longer(w, 2), _pairs(w, "_"), start))


def sound_keys(skel: Column) -> Column:
    return let(words(skel), lambda w: F.concat(F.array(F.concat(F.lit("F:"), F.replace(skel, F.lit(" "), F.lit("")))), _longer(w, 2), _pairs(w, "_")))


def mixed_keys(skel: Column, addr: Column, nums: Column) -> Column:
    sounds = F.slice(_longer(words(skel), 2), 1, 3)
    return F.concat(_cross(sounds, F.slice(_longer(words(addr), 3), 1, 8), "|"), _cross(sounds, F.slice(words(nums), 1, 4), "#"))


def address_keys(addr: Column, nums: Column) -> Column:
    return let(_longer(words(addr), 3), lambda w: F.concat(_cross(F.slice(words(nums), 1, 3), F.slice(w, 1, 4), ":"), _pairs(w, "_")))


def channel_keys(records: DataFrame) -> DataFrame:
    """``entity_id, country, channel, key, tf``: all keys of normalized records, from one scan."""
    c = F.col
    by = {"name_ngram": grams(c("compact")), "phon_key": sound_keys(c("skel")), "mix_key": mixed_keys(c("skel"), c("addr"), c("nums")), "name_key": name_keys(c("name")), "addr_key": address_keys(c("addr"), c("nums"))}
    tag = lambda n, keys: F.transform(keys, lambda k: F.struct(F.lit(n).alias("channel"), k.alias("key")))
    tagged = F.flatten(F.array(*[tag(n, keys) for n, keys in by.items()]))
    d = records.select("entity_id", "country", F.explode(tagged).alias("k")).select("entity_id", "country", "k.channel", "k.key")
    return d.groupBy("entity_id", "country", "channel", "key").agg(F.count(F.lit(1)).alias("tf"))


def key_weights(keys: DataFrame, max_df: int = MAX_KEY_DF, max_gram_share: float = MAX_GRAM_SHARE) -> DataFrame:
    """``country, channel, key, idf`` of the reference records' keys; ln((1 + n) / (1 + df)) + 1.

    A key in more than ``max_df`` records goes, a gram in more than ``max_gram_share`` of its country's records (one at
    least). So a key joins at most so many reference records, and no key is hot.
    """
    n = keys.groupBy("country").agg(F.count_distinct("entity_id").alias("n"))
    df = keys.groupBy("country", "channel", "key").agg(F.count(F.lit(1)).alias("df"))
    most = F.when(F.col("channel") == "name_ngram", F.greatest(F.lit(1), F.floor(F.col("n") * max_gram_share))).otherwise(max_df)
    return df.join(n, "country").where(F.col("df") <= most).select("country", "channel", "key", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def unit_weights(keys: DataFrame, weights: DataFrame) -> DataFrame:
    """``entity_id, country, channel, key, w``: each record's kept keys, of length one in each channel; grams count by 1 + ln tf."""
    tf = F.when(F.col("channel") == "name_ngram", 1 + F.log("tf")).otherwise(F.col("tf"))
    d = keys.join(weights, ["country", "channel", "key"]).withColumn("w", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("entity_id", "channel")))
    return d.select("entity_id", "country", "channel", "key", (F.col("w") / norm).alias("w"))


def retrieve(reference: DataFrame, targets: DataFrame, k: int = TOP_K, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``tid, s1, country`` and the five channel scores: the union of each channel's k best, 0 where a channel has none.

    ``reference`` and ``targets`` are normalized records. Ties go to the smaller s1.
    """
    ref = materialize(channel_keys(reference))
    weights = materialize(key_weights(ref))
    r = unit_weights(ref, weights).select(F.col("entity_id").alias("s1"), "country", "channel", "key", F.col("w").alias("w1"))
    t = unit_weights(ref if targets is reference else channel_keys(targets), weights).select(F.col("entity_id").alias("tid"), "country", "channel", "key", F.col("w").alias("w2"))
    cos = t.join(r, ["country", "channel", "key"]).groupBy("tid", "s1", "country", "channel").agg(F.sum(F.col("w1") * F.col("w2")).alias("cos")).where(F.col("cos") > min_cosine)
    best = Window.partitionBy("tid", "channel").orderBy(F.desc(F.round("cos", DIGITS)), "s1")
    top = cos.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    scores = [F.coalesce(F.max(F.when(F.col("channel") == c, F.col("cos"))), F.lit(0.0)).alias(c) for c in CHANNELS]
    return top.groupBy("tid", "s1", "country").agg(*scores)


def cheap_similarities(pairs: DataFrame, reference: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``pf_name`` and ``pf_addr``: set ratios of names, and of address words with numbers."""
    side = lambda d, key, p: d.select(F.col("entity_id").alias(key), F.col("name").alias(f"{p}name"), F.concat_ws(" ", "addr", "nums").alias(f"{p}an"))
    d = pairs.join(side(targets, "tid", "__t"), "tid", "left").join(side(reference, "s1", "__s"), "s1", "left")
    d = d.withColumns({"pf_name": similarity("set", F.col("__tname"), F.col("__sname")), "pf_addr": similarity("set", F.col("__tan"), F.col("__san"))})
    return d.drop("__tname", "__sname", "__tan", "__san")


def fit_prefilter(pairs: DataFrame, links: DataFrame, sample: int = 40_000) -> dict:
    """Logistic regression over PREFILTER_FEATURES: ``coef, intercept, features``. Fitted on ``sample`` targets of each country, chosen by hash."""
    from pyspark.ml.feature import VectorAssembler

    order = Window.partitionBy("country").orderBy(F.xxhash64("tid", F.lit(0)), "tid")
    some = pairs.select("tid", "country").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("tid")
    d = pairs.join(some, "tid", "left_semi").join(links.select("tid", "s1", F.lit(1.0).alias("y")), ["tid", "s1"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    features = VectorAssembler(inputCols=list(PREFILTER_FEATURES), outputCol="x").transform(d)
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=100, regParam=1e-6).fit(features)
    return {"coef": [float(c) for c in model.coefficients], "intercept": float(model.intercept), "features": list(PREFILTER_FEATURES)}


def rank_candidates(pairs: DataFrame, prefilter: dict, k: int = FINAL_K, digits: int | None = DIGITS) -> DataFrame:
    """Adds ``pf_score``, the prefilter's logit, and ``pf_rank``; keeps each target's k best. Ties go to the smaller s1.

    Ranks look at ``digits`` digits of the logit, or at all of them (None) where the features are exact and not sums of doubles.
    """
    score = F.lit(prefilter["intercept"])
    for c, f in zip(prefilter["coef"], prefilter["features"], strict=True):
        score = score + F.lit(c) * F.col(f)
    d = pairs.withColumn("pf_score", score)
    by = F.col("pf_score") if digits is None else F.round("pf_score", digits)
    return d.withColumn("pf_rank", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc(by), "s1"))).where(F.col("pf_rank") <= k)


def channel_recall(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``channel, recall, without``: the share of true links that a channel finds, and that the union finds without it."""
    hit = links.join(pairs, ["tid", "s1"], "left")
    found = {c: F.coalesce(F.col(c) > 0, F.lit(False)) for c in CHANNELS}
    union = lambda cs: reduce(or_, [found[c] for c in cs])
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), found[c].alias("hit"), union([x for x in CHANNELS if x != c]).alias("rest")) for c in CHANNELS], F.struct(F.lit("union").alias("channel"), union(CHANNELS).alias("hit"), union(CHANNELS).alias("rest")))
    d = hit.select(F.explode(rows).alias("r")).select("r.*")
    return d.groupBy("channel").agg(F.avg(F.col("hit").cast("double")).alias("recall"), F.avg(F.col("rest").cast("double")).alias("without"))


#: Keys that one pass over the documents looks up, about; keys of a block of reference records, about; targets that are compared at a time.
KEYS_AT_ONCE, BLOCK_KEYS, TARGETS_AT_ONCE = 1 << 26, 1 << 22, 32
#: Parts at least into which a country's targets are dealt.
LEAST_PARTS = 3


def best_within(records: DataFrame, k: int = TOP_K, min_cosine: float = MIN_COSINE, max_df: int = MAX_KEY_DF) -> DataFrame:
    """``tid, s1, country, cos``: of the records ``entity_id, country, keys`` (array of strings, repeats counted), each one's k best of its country, itself included, and ties.

    The same cosine as unit_weights() gives, exactly, over keys as 64-bit hashes of country and key. No pair of records that share a key is a row: each record
    travels with all its keys to the tasks that hold a block of reference records, one block of each country at a time, and these tell the best alone. Keys of one record are looked up for its
    norm, and meet none but itself.
    """
    spark = records.sparkSession
    ship_package(spark)
    hashed = records.where("country is not null").select("entity_id", "country", F.transform("keys", lambda x: F.xxhash64("country", x)).alias("h"))
    d = materialize(_counted(hashed).withColumn("num", F.monotonically_increasing_id()))
    if not d.groupBy("entity_id", "country").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        again = F.flatten(F.transform(F.arrays_zip("h", "tf"), lambda x: F.array_repeat(x["h"], x["tf"])))
        d = d.select("entity_id", "country", again.alias("h")).groupBy("entity_id", "country").agg(F.flatten(F.collect_list("h")).alias("h"))
        d = materialize(_counted(d).withColumn("num", F.monotonically_increasing_id()))
    d = d.where(F.size("h") > 0)
    count = materialize(d.groupBy("country").agg(F.count_distinct("entity_id").alias("n"), F.sum(F.size("h")).alias("keys")))
    passes = int((count.agg(F.sum("keys")).first()[0] or 0) // KEYS_AT_ONCE) + 1
    df = materialize(d.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    entries = None
    for i in range(passes):
        of_pass = lambda x: x.where(F.pmod("h", F.lit(passes)) == i)
        e = of_pass(d.select("num", "country", F.explode(F.arrays_zip("h", "tf")).alias("e")).select("num", "country", "e.h", "e.tf"))
        e = e.join(of_pass(df), "h", "left").withColumn("df", F.coalesce("df", F.lit(1))).where(F.col("df") <= max_df).join(F.broadcast(count.select("country", "n")), "country")
        w = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
        part = e.groupBy("num").agg(F.sum(w * w).alias("norm"), F.collect_list(F.when(F.col("df") > 1, F.struct("h", (F.col("tf").cast("long") * (max_df + 1) + F.col("df")).alias("p")))).alias("e"))
        part = materialize(part)
        entries = part if entries is None else entries.unionByName(part)
    norms = entries.groupBy("num").agg(F.sum("norm").alias("norm")).join(d.select("num", "entity_id", "country"), "num")
    whole = norms.groupBy(F.col("entity_id").alias("same_id")).agg(F.sqrt(F.sum("norm")).alias("whole"))
    joined = norms.join(whole, F.col("entity_id").eqNullSafe(F.col("same_id")))
    who = materialize(joined.select("num", "entity_id", "country", (F.col("norm") / F.pow("whole", F.lit(2))).alias("own"), "whole"))
    sizes = entries.join(who.select("num", "country"), "num").groupBy("country").agg(F.sum(F.size("e")).alias("kept"))
    blocks = F.floor(F.col("kept") / BLOCK_KEYS).cast("int") + 1
    sizes = materialize(sizes.join(count.select("country", "n"), "country").select("country", "n", blocks.alias("blocks"), F.greatest(blocks, F.lit(LEAST_PARTS)).alias("parts")))
    most = sizes.agg(F.max("blocks"), F.sum("parts")).first()
    placed = entries.drop("norm").where(F.size("e") > 0).join(who.select("num", "country", "whole"), "num").join(F.broadcast(sizes), "country")
    found = who.where(F.col("own") > min_cosine).select(F.col("num").alias("a"), F.col("num").alias("b"), F.col("own").alias("cos"))
    for i in range(most[0] or 0):
        here = placed.where(F.col("blocks") > i)
        ref = here.where(F.pmod(F.xxhash64("num"), F.col("blocks")) == i).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("target", F.lit(False))
        tgt = here.withColumn("part", F.pmod(F.xxhash64("num", F.lit(1)), F.col("parts")).cast("int")).withColumn("target", F.lit(True))
        rows = ref.unionByName(tgt).select("country", "part", "target", "num", "whole", "n", "e")
        rows = rows.repartition(4 * int(most[1]), "country", "part").sortWithinPartitions("country", "part", "target", "num")
        best = materialize(rows.mapInArrow(partial(_compare, k=k, min_cosine=min_cosine, radix=max_df + 1), "a long, b long, cos double"))
        found = found.unionByName(best)
    name = lambda n, as_: who.select(F.col("num").alias(n), F.col("entity_id").alias(as_))
    return found.join(who.select(F.col("num").alias("a"), F.col("entity_id").alias("tid"), "country"), "a").join(name("b", "s1"), "b").select("tid", "s1", "country", "cos")


def _counted(d: DataFrame) -> DataFrame:
    """Distinct hashes of ``h`` with their numbers, ``tf``."""

    def count(batches):
        import numpy as np

        for b in batches:
            hashes, numbers = [], []
            for x in b.column(0):
                h, n = np.unique(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, "i8"), return_counts=True)
                hashes.append(h)
                numbers.append(n.astype("i4"))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int32())), *b.columns[1:]], ["h", "tf", *b.schema.names[1:]])

    rest = [f"`{c}` {t}" for c, t in d.dtypes if c != "h"]
    return d.select("h", *[c for c in d.columns if c != "h"]).mapInArrow(count, ", ".join(["h array<long>", "tf array<int>", *rest]))


class _Block:
    """The keys of some records, flat: number, norm, key and weight."""

    def __init__(self):
        self.parts = []

    def add(self, num, whole, lengths, h, w):
        import numpy as np

        self.parts.append((np.repeat(num, lengths), np.repeat(whole, lengths), h, w))

    def flat(self):
        import numpy as np

        num, whole, h, w = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ids, at = np.unique(num, return_inverse=True)
        return ids, at, h, w / whole

    def index(self):
        import numpy as np

        self.ids, at, h, w = self.flat()
        order = np.argsort(h, kind="stable")
        self.h, self.start = np.unique(h[order], return_index=True)
        self.end = np.append(self.start[1:], len(h))
        self.at, self.w, self.parts = at[order], w[order], []


def _compare(batches, k: int, min_cosine: float, radix: int):
    """Best pairs of each country's part: its reference rows come first, then its targets."""
    import numpy as np

    def told(targets, block):
        ids, at, h, w = targets.flat()
        order = np.argsort(at, kind="stable")
        at, h, w = at[order], h[order], w[order]
        cut = np.searchsorted(at, np.arange(0, len(ids) + TARGETS_AT_ONCE, TARGETS_AT_ONCE))
        for first, (s, e) in zip(range(0, len(ids), TARGETS_AT_ONCE), zip(cut[:-1], cut[1:], strict=True), strict=False):
            i = np.searchsorted(block.h, h[s:e])
            hit = np.flatnonzero(block.h[np.minimum(i, len(block.h) - 1)] == h[s:e])
            i = i[hit]
            many = block.end[i] - block.start[i]
            place = np.arange(many.sum()) + np.repeat(block.start[i] - (many.cumsum() - many), many)
            cell = np.repeat((at[s:e][hit] - first) * len(block.ids), many) + block.at[place]
            some = min(TARGETS_AT_ONCE, len(ids) - first)
            cos = np.bincount(cell, np.repeat(w[s:e][hit], many) * block.w[place], some * len(block.ids)).reshape(some, -1)
            t, r = np.nonzero(cos > min_cosine)
            own = ids[first + t] == block.ids[r]
            t, r = t[~own], r[~own]
            c = cos[t, r]
            for row in np.flatnonzero(np.bincount(t, minlength=some) > k):
                here = np.flatnonzero(t == row)
                least = np.partition(c[here], -k)[-k] - 2 * 10.0**-8  # ranks look at eight digits
                c[here[c[here] < least]] = -1
            t, r, c = t[c > 0], r[c > 0], c[c > 0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[first + t]), pa.array(block.ids[r]), pa.array(c)], ["a", "b", "cos"])

    now, block, ready, targets = None, None, False, None
    for b in batches:
        country, part, target = (b.column(i).to_pylist() for i in range(3))
        num, whole, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3, 6))
        lists = b.column(6)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
        h, p = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        w = (p // radix) * (np.log((1 + np.repeat(n, lengths)) / (1 + p % radix)) + 1)
        ends = np.append(0, lengths.cumsum())
        changes = [0, *[i for i in range(1, len(part)) if (country[i], part[i], target[i]) != (country[i - 1], part[i - 1], target[i - 1])], len(part)]
        for s, e in zip(changes[:-1], changes[1:], strict=True):
            if (country[s], part[s]) != now:
                if targets and targets.parts and ready:
                    yield from told(targets, block)
                now, block, ready, targets = (country[s], part[s]), _Block(), False, _Block()
            into = targets if target[s] else block
            if target[s] and not ready and block.parts:
                block.index()
                ready = True
            into.add(num[s:e], whole[s:e], lengths[s:e], h[ends[s] : ends[e]], w[ends[s] : ends[e]])
    if targets and targets.parts and ready:
        yield from told(targets, block)
