"""Stage 2: how a pair stands within its target and its reference record's group, and extra evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.similarity import similarity
from recordloom.functions.text import words

#: Pairs in play, confident pairs, siblings compared.
MIN_P, CONFIDENT_P, SURE_P, SIBLINGS = 0.01, 0.5, 0.9, 6
GROUP_FEATURES = (
    "p", "logit", "rank", "p_gap", "p_best_other", "g_n_ex", "g_n9_ex", "g_sum_ex", "alt_g_n",
    "sib_k", "sib_addr_max", "sib_addr_mean", "sib_name_max", "sib_name_mean", "sib_num_max", "sib_same_addr",
    "s1_skel_freq", "s1_name_freq", "t_skel_freq", "t_addr_empty", "t_has_num", "is_s3",
)
SCORE_FEATURES = ("ce", "ce_logit", "ce_gap", "ce_rank", "ce_best_other", "s1_addr_n", "s1_street_n", "t_addr_n", "same_addr")
COHESION_FEATURES = ("grp_name_to_s1", "grp_addr_to_s1", "grp_num_to_s1", "grp_name_min", "orphan_name", "orphan_addr", "self_vs_grp_name")
NAME_FEATURES = ("name_idf_jac", "s_idf_cov", "s_missing_max", "t_extra_max")


def logit(p: Column) -> Column:
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(c) - F.log(1 - c)


def standing(pred: DataFrame) -> DataFrame:
    """The pairs in play with rank, gap, best other and leave-one-out sums of their group; ``pred`` is tid, s1, country, p.

    All of a target's columns come from one exchange on tid. Group sums are of targets that rank the record first, less the pair's own.
    """
    t = Window.partitionBy("tid")
    order = t.orderBy(F.desc("p"), "s1")
    second = F.coalesce(F.nth_value("p", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    d = pred.withColumns({"rank": F.row_number().over(order), "__top": F.max("p").over(t), "__second": second})
    own = F.col("rank") == 1
    g = d.where(own).groupBy("s1").agg(*[F.count_if(F.col("p") >= x).cast("int").alias(n) for n, x in (("g_n", CONFIDENT_P), ("g_n9", SURE_P))], F.sum("p").alias("g_sum"))
    q = d.where(F.col("p") >= MIN_P).join(g, "s1", "left")
    less = lambda n, x: F.coalesce(n, F.lit(0)) - (own & (F.col("p") >= x)).cast("int")
    q = q.withColumns(
        {
            "g_n_ex": less("g_n", CONFIDENT_P), "g_n9_ex": less("g_n9", SURE_P), "g_sum_ex": F.coalesce("g_sum", F.lit(0.0)) - F.when(own, F.col("p")).otherwise(0.0),
            "p_gap": F.col("__top") - F.col("p"), "p_best_other": F.when(own, F.col("__second")).otherwise(F.col("__top")), "logit": logit(F.col("p")),
        }
    )
    big = F.sort_array(F.collect_list("g_n_ex").over(t), asc=False)  # a target's candidates in play
    alt = F.when(F.get(big, F.lit(0)) == F.col("g_n_ex"), F.get(big, F.lit(1))).otherwise(F.get(big, F.lit(0)))
    return q.withColumn("alt_g_n", F.coalesce(alt, F.lit(0))).drop("g_n", "g_n9", "g_sum", "__top", "__second")


def sibling_pairs(pred: DataFrame, most: int = SIBLINGS) -> DataFrame:
    """``tid, s1, sib``: the pairs in play with up to ``most`` confident members of the record's group, the target itself left out."""
    first = pred.withColumn("r", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("p"), "s1"))).where("r = 1").where(F.col("p") >= CONFIDENT_P)
    sib = first.withColumn("k", F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("p"), "tid"))).where(F.col("k") <= most).select("s1", F.col("tid").alias("sib"))
    return pred.where(F.col("p") >= MIN_P).select("tid", "s1").join(sib, "s1").where("tid <> sib")


def sibling_features(pred: DataFrame, targets: DataFrame) -> DataFrame:
    """``tid, s1`` and the sib_ columns, for pairs that have siblings."""
    text = targets.select("entity_id", "name", F.concat_ws(" ", "addr", "nums").alias("an"), "nums")
    side = lambda key, p: text.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}{c}") for c in ("name", "an", "nums")])
    j = sibling_pairs(pred).join(side("tid", "a_"), "tid").join(side("sib", "b_"), "sib")
    j = j.withColumns({k: similarity("set", F.col(f"a_{c}"), F.col(f"b_{c}")) for k, c in (("sa", "an"), ("sn", "name"), ("sm", "nums"))})
    same = (F.col("a_an") == F.col("b_an")) & (F.trim("a_an") != "")
    return j.groupBy("tid", "s1").agg(
        F.count(F.lit(1)).cast("int").alias("sib_k"), F.max("sa").alias("sib_addr_max"), F.avg("sa").alias("sib_addr_mean"), F.max("sn").alias("sib_name_max"),
        F.avg("sn").alias("sib_name_mean"), F.max("sm").alias("sib_num_max"), F.bool_or(same).cast("int").alias("sib_same_addr"),
    )


def group_features(pred: DataFrame, reference: DataFrame, targets: DataFrame) -> DataFrame:
    """``tid, s1, country`` and GROUP_FEATURES for the pairs in play. Pairs without siblings have sib_k 0 and null sib_ columns."""
    q = standing(pred).join(sibling_features(pred, targets), ["tid", "s1"], "left").withColumn("sib_k", F.coalesce("sib_k", F.lit(0)))
    per = lambda c, n: reference.groupBy("country", c).agg(F.count(F.lit(1)).alias(n))
    skels = per("skel", "s1_skel_freq")
    s = reference.join(skels, ["country", "skel"]).join(per("name", "s1_name_freq"), ["country", "name"]).select(F.col("entity_id").alias("s1"), "s1_skel_freq", "s1_name_freq")
    t = targets.join(skels, ["country", "skel"], "left").select(F.col("entity_id").alias("tid"), F.coalesce("s1_skel_freq", F.lit(0)).alias("t_skel_freq"), F.col("addr_empty").cast("int").alias("t_addr_empty"), (F.col("nums") != "").cast("int").alias("t_has_num"))
    return q.join(s, "s1", "left").join(t, "tid", "left").withColumn("is_s3", F.col("tid").startswith("S3").cast("int")).select("tid", "s1", "country", *GROUP_FEATURES)


def score_standing(scores: DataFrame, col: str = "ce") -> DataFrame:
    """Adds a pair score's logit, gap to the target's best, rank, and best other: ``tid, s1, ce, ce_logit, ce_gap, ce_rank, ce_best_other``."""
    t = Window.partitionBy("tid")
    order = t.orderBy(F.desc(col), "s1")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = scores.select("tid", "s1", col)
    d = d.withColumns({f"{col}_logit": logit(F.col(col)), f"{col}_gap": F.max(col).over(t) - F.col(col), f"{col}_rank": F.row_number().over(order), "__1": F.first(col).over(every), "__2": F.nth_value(col, 2).over(every)})
    return d.withColumn(f"{col}_best_other", F.coalesce(F.when(F.col(f"{col}_rank") == 1, F.col("__2")).otherwise(F.col("__1")), F.lit(0.0))).drop("__1", "__2")


def address_crowding(reference: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s1, s_akey, s1_addr_n, s1_street_n) and (tid, t_akey, t_addr_n): how many reference records of a country share an address, or its words."""
    street = F.when(F.col("addr") != "", F.col("addr"))
    key = F.when(F.col("addr") != "", F.concat("addr", F.lit("|"), "nums"))
    s, t = reference.withColumns({"akey": key, "skey": street}), targets.withColumn("akey", key)
    keyed = s
    count = lambda c, n: keyed.where(F.col(c).isNotNull()).groupBy("country", c).agg(F.count(F.lit(1)).alias(n))
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = s.join(count("akey", "an"), ["country", "akey"], "left").join(count("skey", "sn"), ["country", "skey"], "left")
    s = s.select(F.col("entity_id").alias("s1"), F.col("akey").alias("s_akey"), zero("an").alias("s1_addr_n"), zero("sn").alias("s1_street_n"))
    t = t.join(count("akey", "an"), ["country", "akey"], "left").select(F.col("entity_id").alias("tid"), F.col("akey").alias("t_akey"), zero("an").alias("t_addr_n"))
    return s, t


def add_scores(features: DataFrame, scores: DataFrame, reference: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds SCORE_FEATURES. ``scores`` (tid, s1, ce) must cover all pairs; pairs without a score go."""
    s, t = address_crowding(reference, targets)
    d = features.join(score_standing(scores), ["tid", "s1"]).join(s, "s1", "left").join(t, "tid", "left")
    return d.withColumn("same_addr", F.coalesce(F.col("s_akey") == F.col("t_akey"), F.lit(False)).cast("int")).drop("s_akey", "t_akey")


def name_weights(reference: DataFrame) -> DataFrame:
    """``country, tok, idf``: ln(records / records with the word), over the reference names of a country."""
    n = reference.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    df = reference.select("country", F.explode(F.array_distinct(words(F.col("name")))).alias("tok")).groupBy("country", "tok").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "country").select("country", "tok", F.log(F.col("n") / F.col("df")).alias("idf"))


def add_name_weights(features: DataFrame, reference: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds NAME_FEATURES: weighted overlap of name words, and the heaviest words of one side alone."""
    most = reference.groupBy("country").agg(F.log(F.count(F.lit(1)).cast("double")).alias("top"))
    toks = lambda d, key: d.select(F.col("entity_id").alias(key), F.array_distinct(words(F.col("name"))).alias(f"{key}_w"))
    pairs = features.select("tid", "s1", "country").distinct().join(toks(reference, "s1"), "s1", "left").join(toks(targets, "tid"), "tid", "left")
    none = F.array().cast("array<string>")
    pairs = pairs.withColumns({"a": F.coalesce("s1_w", none), "b": F.coalesce("tid_w", none)})
    # set operations by hash: a text's words are looked up once each, however long it is
    tag = lambda words_, s, t: F.transform(words_, lambda w: F.struct(w.alias("tok"), F.lit(s).alias("in_s"), F.lit(t).alias("in_t")))
    tagged = F.concat(tag(F.array_intersect("a", "b"), True, True), tag(F.array_except("a", "b"), True, False), tag(F.array_except("b", "a"), False, True))
    d = pairs.select("tid", "s1", "country", F.explode(tagged).alias("x")).select("tid", "s1", "country", "x.*")
    d = d.join(name_weights(reference), ["country", "tok"], "left").join(most, "country", "left").withColumn("w", F.coalesce("idf", "top"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0.0))
    top = lambda c: F.coalesce(F.max(F.when(c, F.col("w"))), F.lit(0.0))
    s, t = F.col("in_s"), F.col("in_t")
    g = d.groupBy("tid", "s1").agg(total(s).alias("ws"), total(t).alias("wt"), total(s & t).alias("wb"), top(s & ~t).alias("s_missing_max"), top(t & ~s).alias("t_extra_max"))
    share = lambda n, m: F.when(m != 0, n / m).otherwise(0.0)
    g = g.withColumns({"name_idf_jac": share(F.col("wb"), F.col("ws") + F.col("wt") - F.col("wb")), "s_idf_cov": share(F.col("wb"), F.col("ws"))}).select("tid", "s1", *NAME_FEATURES)
    return features.join(g, ["tid", "s1"], "left").fillna(0.0, subset=list(NAME_FEATURES))


def rescore(pred: DataFrame, second: DataFrame) -> DataFrame:
    """``pred`` with the second stage's probability (tid, s1, p2) where there is one."""
    return pred.join(second.select("tid", "s1", "p2"), ["tid", "s1"], "left").withColumn("p", F.coalesce("p2", "p")).drop("p2")


def two_scorers(features: DataFrame, second: DataFrame, name: str = "ce2") -> DataFrame:
    """``features`` with another pair score (tid, s1, ``name``) and its logit beside the first; null where it has none."""
    return features.join(second.select("tid", "s1", name), ["tid", "s1"], "left").withColumn(f"{name}_logit", F.when(F.col(name).isNotNull(), logit(F.col(name))))


def cohesion(group: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds COHESION_FEATURES: how the other confident members of a record's group agree with the record, and how a pair stands to that.

    ``group`` has GROUP_FEATURES; ``evidence`` has tid, s1, n_tset, a_tset, num_jac. Means are null where a record has no other confident member.
    Records that are missing leave groups that agree with each other but loosely with the record they were drawn to.
    """
    d = group.join(evidence.select("tid", "s1", "n_tset", "a_tset", "num_jac"), ["tid", "s1"], "left")
    w = Window.partitionBy("s1")
    member = (F.col("rank") == 1) & (F.col("p") >= CONFIDENT_P)
    others = F.count_if(member).over(w) - member.cast("int")
    mean = lambda c: F.when(others > 0, (F.sum(F.when(member, F.col(c))).over(w) - F.when(member, F.col(c)).otherwise(0.0)) / others)
    d = d.withColumns({"grp_name_to_s1": mean("n_tset"), "grp_addr_to_s1": mean("a_tset"), "grp_num_to_s1": mean("num_jac"), "grp_name_min": F.min(F.when(member, F.col("n_tset"))).over(w)})
    c = F.col
    return d.withColumns({"orphan_name": c("sib_name_mean") - c("grp_name_to_s1"), "orphan_addr": c("sib_addr_mean") - c("grp_addr_to_s1"), "self_vs_grp_name": c("n_tset") - c("grp_name_to_s1")})
