"""More registered queries: parts as records for features, diagnostics and the rescue lane; sources and sinks; samples. Each has SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom import oracle_pairs as sql
from recordloom.functions import text
from recordloom.functions.similarity import similarity
from recordloom.operators import assignment, blocking, diagnostics, group_features, metrics, pair_features, rescue, splits, vectors
from recordloom.plans import models
from recordloom.session import materialize, scratch
from recordloom.sources import sinks, tables, validate

PREFILTER = {"coef": [1.5, 0.75, 0.5, 1.25, 1.0, 2.0, 1.5], "intercept": -2.5, "features": list(blocking.PREFILTER_FEATURES)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(d: DataFrame, digits: int = 9) -> DataFrame:
    return d.withColumns({c: F.round(c, digits) for c, t in d.dtypes if t == "double"})


def records(spark: SparkSession, sf_dir: str, target: bool = False) -> DataFrame:
    """Parts as normalized records of their brand; S1- ids, or S2- and S3- as targets."""
    k, kind = F.col("p_partkey"), F.lower("p_type")
    name = F.concat("p_name", F.when(k % 3 == 0, F.concat(F.lit(" "), kind)).otherwise(""))
    d = table(spark, sf_dir, "part").select(
        (F.concat(F.when(k % 2 == 0, "S2-").otherwise("S3-"), k) if target else F.concat(F.lit("S1-"), k)).alias("entity_id"), F.col("p_brand").alias("country"), name.alias("name"),
        F.when(k % 5 == 0, "").otherwise(F.concat(kind, F.lit(" "), F.split("p_name", " ")[0])).alias("addr"), F.when(k % 4 == 0, "").otherwise(F.concat_ws(" ", "p_size", k % 10)).alias("nums"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "ca").otherwise("tx").alias("state"), F.when(k % 2 == 0, "").otherwise("llc").alias("legal"),
    )
    return d.withColumns({"compact": F.replace("name", F.lit(" "), F.lit("")), "skel": F.regexp_replace("name", "[aeiou]", ""), "addr_empty": F.col("addr") == ""})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the next three of its brand, and a score by integer arithmetic."""
    w = Window.partitionBy("country").orderBy("k")
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("country"))
    d = d.withColumn("n", F.array(*[F.lead("k", i).over(w) for i in (1, 2, 3)])).select("k", "country", F.posexplode("n").alias("step", "j")).where("j is not null")
    p = (F.pmod(F.col("k") * 7919 + F.col("j") * 104729, F.lit(9973)) + 1) / 9975.0
    return d.select(F.concat(F.when(F.col("k") % 2 == 0, "S2-").otherwise("S3-"), "k").alias("tid"), F.concat(F.lit("S1-"), "j").alias("s1"), "country", p.alias("p"), (F.col("step") + 1).alias("step"), "k")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).drop("step", "k")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where((F.col("step") == 1) & (F.col("k") % 4 != 0)).select("tid", "s1")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, t = materialize(records(spark, sf_dir)), materialize(records(spark, sf_dir, True))
    return materialize(blocking.rank_candidates(blocking.cheap_similarities(blocking.retrieve(r, t), r, t), PREFILTER))


# ---------------------------------------------------------------- blocking and features


def q_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four word and edit similarities of every two part names."""
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    d = n.select(F.col("p_name").alias("a"), F.lit(1).alias("one")).join(n.select(F.col("p_name").alias("b"), F.lit(1).alias("one")), "one").drop("one")
    return rounded(d.select("a", "b", *[similarity(k, F.col("a"), F.col("b")).alias(k) for k in ("ratio", "sorted", "set", "partial")]))


def q_channel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.channel_keys(records(spark, sf_dir)).select("entity_id", "channel", "key", "tf")


def q_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the five channels' best, with each one's cosine."""
    return rounded(blocking.retrieve(records(spark, sf_dir), records(spark, sf_dir, True)), 6)


def q_block_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five channels, the cheap similarities, and the prefilter's eight best."""
    return rounded(candidates(spark, sf_dir), 6)


def q_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 41 features of the union's pairs."""
    return rounded(pair_features.pair_features(pair_features.with_context(candidates(spark, sf_dir)), records(spark, sf_dir), records(spark, sf_dir, True)), 6)


def q_channel_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocking.channel_recall(blocking.retrieve(records(spark, sf_dir), records(spark, sf_dir, True)), links(spark, sf_dir)))


def q_group_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 22 stage-2 features."""
    return rounded(group_features.group_features(pairs(spark, sf_dir), records(spark, sf_dir), records(spark, sf_dir, True)), 6)


def q_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's confident members against the record: scores stand for the similarities."""
    p = pairs(spark, sf_dir)
    group = group_features.standing(p).select("tid", "s1", "rank", "p", (F.col("p") / 2).alias("sib_name_mean"), (F.col("p") / 3).alias("sib_addr_mean"))
    evidence = p.select("tid", "s1", (1 - F.col("p")).alias("n_tset"), (F.col("p") * F.col("p")).alias("a_tset"), (F.col("p") / 4).alias("num_jac"))
    return rounded(group_features.cohesion(group, evidence).select("tid", "s1", *group_features.COHESION_FEATURES))


def q_two_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scorer beside the first, with address crowding."""
    p = pairs(spark, sf_dir)
    d = group_features.add_scores(p.select("tid", "s1"), p.withColumnRenamed("p", "ce"), records(spark, sf_dir), records(spark, sf_dir, True))
    second = p.where("p >= 0.3").select("tid", "s1", (1 - F.col("p")).alias("ce2"))
    return rounded(group_features.two_scorers(d, second).select("tid", "s1", *group_features.SCORE_FEATURES, "ce2", "ce2_logit"))


def q_gram_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted character n-grams of both records' texts."""
    raw = lambda t: records(spark, sf_dir, t).select("entity_id", F.col("name").alias("business_name"), F.col("addr").alias("business_address"))
    return rounded(models.gram_cosine(pairs(spark, sf_dir), raw(False), raw(True)), 6)


def q_normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as raw records, normalized as a frame."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    d = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S1-"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("business_name"), F.concat(F.lit("12 "), F.lower("n_name")).alias("business_address"), F.lit("IN").alias("country"))
    return text.normalize_records(d).select("entity_id", "country", "name", "compact", "nums", "addr_empty")


# ---------------------------------------------------------------- assignment, tuning, diagnostics


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    t = links(spark, sf_dir).groupBy("s1").agg(F.collect_list("tid").alias("tids"))
    return records(spark, sf_dir).select(F.col("entity_id").alias("s1")).join(t, "s1", "left").select("s1", F.coalesce("tids", none).alias("tids"))


def q_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid of decision rules with its scores: a row for each of the 16 points."""
    _, grid = metrics.tune(materialize(pairs(spark, sf_dir)), materialize(truth(spark, sf_dir)))
    rows = [(g["threshold"], g["expected_f"], round(g["macro_f05"], 9), round(g["macro_precision"], 9), round(g["macro_recall"], 9)) for g in grid]
    return spark.createDataFrame(rows, "threshold double, expected_f boolean, macro_f05 double, macro_precision double, macro_recall double")


def q_oracle_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return rounded(diagnostics.oracle_ceilings(truth(spark, sf_dir), assignment.assign(p, 0.5), p))


def q_relation_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.relation_bins(pairs(spark, sf_dir), records(spark, sf_dir), records(spark, sf_dir, True))


def q_swap_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.swap_rates(diagnostics.swap_flags(pairs(spark, sf_dir), records(spark, sf_dir), records(spark, sf_dir, True))))


def _lists(d: DataFrame) -> DataFrame:
    return d.select("s1", F.array_join(F.array_sort("tids"), ",").alias("tids"))


def q_loosened(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return _lists(diagnostics.loosened(assignment.assign(p, 0.7, expected_f=False), p, records(spark, sf_dir), records(spark, sf_dir, True), 0.5, "Brand#2", 0.6))


def q_tightened(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return _lists(diagnostics.tightened(assignment.assign(p, 0.5, expected_f=False), p, 0.9, "Brand#2", records(spark, sf_dir)))


def q_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the records of one brand."""
    s1 = records(spark, sf_dir).where("country = 'Brand#2'").select(F.col("entity_id").alias("s1"))
    return rounded(diagnostics.neighbourhood(s1, links(spark, sf_dir), pairs(spark, sf_dir), records(spark, sf_dir), records(spark, sf_dir, True)))


def q_native_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations by language script."""
    d = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.avg(diagnostics.native_script(F.col("text")).cast("double")).alias("share"))
    return rounded(d)


def q_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs(spark, sf_dir).join(links(spark, sf_dir).withColumn("y", F.lit(1)), ["tid", "s1"], "left").fillna(0, subset=["y"])
    return rounded(metrics.auc(d.withColumn("p", F.round("p", 2))))


def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.describe(table(spark, sf_dir, "part"), ("p_size", "p_retailprice")).unionByName(metrics.describe(pairs(spark, sf_dir), ("p",))), 6)


# ---------------------------------------------------------------- samples and splits


def q_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's fold, half and drop."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), "c_custkey").alias("s1"))
    dropped = splits.dropped_records(c).withColumn("dropped", F.lit(True))
    d = c.withColumns({"fold": splits.fold("s1", 2, models.FOLD_SEED), "half": splits.fold("s1", 2, models.HALF_SEED), "tenth": splits.fold("s1", 10, models.STOP_SEED)})
    return d.join(dropped, "s1", "left").fillna(False, subset=["dropped"])


def q_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty customers, and five of each nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return splits.sample_rows(c, 50, "c_custkey").withColumn("kind", F.lit("all")).unionByName(splits.sample_rows(c, 5, "c_custkey", 3, ("c_nationkey",)).withColumn("kind", F.lit("each")))


def q_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out records, the targets that touch them, and the targets safe to train on."""
    held, touched, pool = splits.validation_split(pairs(spark, sf_dir), links(spark, sf_dir), truth(spark, sf_dir), splits.dropped_records(truth(spark, sf_dir)), 0.1)
    row = lambda d, c, part: d.select(F.col(c).alias("id"), F.lit(part).alias("part"))
    return row(held, "s1", "held").unionByName(row(touched, "tid", "touched")).unionByName(row(pool, "tid", "pool"))


def q_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union without repeats, semi-join, and the first rows of an order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    owners = o.select(F.col("o_custkey").alias("c_custkey"))
    semi = c.join(owners, "c_custkey", "left_semi").select(F.col("c_custkey").alias("k"), F.lit("semi").alias("kind"))
    union = owners.unionByName(c.where("c_acctbal < 0").select("c_custkey")).distinct().select(F.col("c_custkey").alias("k"), F.lit("union").alias("kind"))
    head = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("k"), F.lit("head").alias("kind"))
    return semi.unionByName(union).unionByName(head)


# ---------------------------------------------------------------- rescue lane


def _vectors(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit(prefix), "vec_id").alias("entity_id"), F.col("label").cast("string").alias("country"), "embedding")


def _vector_records(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit(prefix), i).alias("entity_id"), F.concat(F.lit("name "), i % 7).alias("name"), F.concat(F.lit("way "), i % 5).alias("addr"), (i % 3).cast("string").alias("nums"))


def _vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a target of the next of its label, scored by its number."""
    w = Window.partitionBy("label").orderBy("vec_id")
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.lead("vec_id").over(w).alias("j"), F.col("label").cast("string").alias("country")).where("j is not null")
    return d.select(F.concat(F.lit("S3-"), "vec_id").alias("tid"), F.concat(F.lit("S1-"), "j").alias("s1"), "country", (F.pmod(F.col("vec_id"), F.lit(10)) / 10.0).alias("p"))


def rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _vector_pairs(spark, sf_dir)
    d = rescue.rescue_candidates(p, p, _vectors(spark, sf_dir, "S3-"), _vectors(spark, sf_dir, "S1-"), _vector_records(spark, sf_dir, "S3-"), _vector_records(spark, sf_dir, "S1-"))
    number = lambda c: F.split(c, "-")[1].cast("long")
    scores = d.select("tid", "s1", ((F.pmod(number("tid") * 31 + number("s1") * 17, F.lit(997)) + 1) / 999.0).alias("ce"))
    return rescue.rescue_features(materialize(d), scores)


def q_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest records of targets without a good pair, with the lane's twelve features."""
    return rounded(rescued(spark, sf_dir).select("tid", "s1", "country", *rescue.RESCUE_FEATURES), 6)


def q_merge_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rescued(spark, sf_dir).withColumn("p", F.col("ce"))
    return rounded(rescue.merge_rescue(_vector_pairs(spark, sf_dir), d, ("3",)), 6)


def q_solo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors alone, and the best link of each target."""
    d = vectors.solo(_vectors(spark, sf_dir, "S2-"), _vectors(spark, sf_dir, "S1-"), 8.0, -4.0, exclude_same=False)
    return rounded(d, 6)


def q_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as targets; the nearest records are the next three, the held-out ones every seventh."""
    p = pairs(spark, sf_dir)
    best = p.groupBy("tid").agg((F.max("p") / 40).alias("p1"))
    number = F.substring("tid", 4, 20).cast("long")
    tids = p.select("tid").distinct()
    held = records(spark, sf_dir).select(F.col("entity_id").alias("s1")).where(F.substring("s1", 4, 20).cast("long") % 7 == 0)
    pool = tids.where(number % 2 == 0)
    return rescue.widen(best, held, tids.where(number % 11 == 0), pool, tids.where(number % 6 == 0), p, share=0.5)


# ---------------------------------------------------------------- sources and sinks


def _supplier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = F.concat(F.lit('"'), "s_name", F.lit('" & co'))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S1-"), "s_suppkey").alias("entity_id"), name.alias("business_name"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("business_address"), F.col("n_name").alias("country"))


def q_tsv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through tab-separated files with quotes as characters: two target sources, and only listed ids of some columns."""
    d = _supplier_records(spark, sf_dir)
    with scratch(spark) as path:
        layout = tables.Layout(*(f"{path}/{x}" for x in ("data", "work", "out")))
        for number, part in ((2, d.where("business_address = ''")), (3, d.where("business_address <> ''"))):
            sinks.write_tsv(part, layout.source("train", number))
        every = tables.read_targets(spark, layout.source("train", 2), layout.source("train", 3))
        listed = tables.only(tables.read_tsv(spark, layout.source("train", 3), tables.RECORD_COLUMNS), d.where("country < 'NATION_2'").select("entity_id"), ("entity_id", "business_name"))
        out = every.select("entity_id", "business_name", "business_address", "country", F.lit("all").alias("kind"))
        return materialize(out.unionByName(listed.select("entity_id", "business_name", F.lit("").alias("business_address"), F.lit("").alias("country"), F.lit("listed").alias("kind"))))


def q_quoted_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quoted file: quotes go, and a tab inside them stays."""
    d = table(spark, sf_dir, "supplier").select(F.concat_ws("\t", "s_suppkey", F.concat(F.lit('"'), "s_name", F.lit('\tx"'))).alias("value"))
    with scratch(spark) as path:
        spark.createDataFrame([("id\tname",)], "value string").unionByName(d).coalesce(1).write.text(path)
        return materialize(tables.read_tsv(spark, path, quoted=True).select("id", "name"))


def q_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table is made once: the second call reads the first one's rows."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("region"))
    with scratch(spark) as path:
        sinks.stage(spark, f"{path}/stage", lambda: n, ("region",))
        return materialize(sinks.stage(spark, f"{path}/stage", lambda: n.limit(0), ("region",)).select("n_nationkey", "n_name", F.col("region").cast("long")))


def q_json_and_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision through a JSON file, a report through a CSV file."""
    with scratch(spark) as path:
        sinks.write_json(spark, {"threshold": 0.5, "expected_f": True}, f"{path}/decision.json")
        got = tables.read_json(spark, f"{path}/decision.json")
        sinks.write_csv(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), f"{path}/report")
        d = spark.read.option("header", True).schema("r_regionkey long, r_name string").csv(f"{path}/report")
        return materialize(d.withColumns({"threshold": F.lit(got["threshold"]), "expected_f": F.lit(got["expected_f"])}))


def _write_lists(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """A result file of parts with some faults: the lists of best links, repeated ids for every tenth record, own ids for every eleventh."""
    r = records(spark, sf_dir)
    p = pairs(spark, sf_dir)
    d = assignment.assign(p, 0.5, expected_f=False).withColumn("tids", F.array_sort("tids"))
    d = sinks.id_lists(r.where("addr <> ''"), d, "matched_entity_ids")
    k = F.substring("source1_entity_id", 4, 20).cast("long")
    ids = F.col("matched_entity_ids")
    fault = F.when((k % 10 == 0) & (ids != ""), F.concat(ids, F.lit(","), F.split(ids, ",")[0])).when(k % 11 == 0, F.concat_ws(",", F.when(ids != "", ids), "source1_entity_id")).when(k % 13 == 0, "X9,S2-0").otherwise(ids)
    sinks.write_tsv(d.select("source1_entity_id", fault.alias("matched_entity_ids")), path)
    return r


def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a result file with planted faults."""
    with scratch(spark) as path:
        r = _write_lists(spark, sf_dir, path)
        d = validate.validate(spark, path, None, r, records(spark, sf_dir, True).where("addr <> ''"))
        return materialize(d.select("rule", "severity", "n", F.array_join("examples", ",").alias("examples")))


def q_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the file, parsed."""
    with scratch(spark) as path:
        _write_lists(spark, sf_dir, path)
        return materialize(validate.parse_lines(spark.read.text(path)).where("s1 <> 'source1_entity_id'").select("s1", F.array_join("ids", ",").alias("ids")))


def q_rewrite_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brand's lists are replaced by those of a higher threshold."""
    r, p = records(spark, sf_dir), pairs(spark, sf_dir)
    old = sinks.id_lists(r, assignment.assign(p, 0.5, expected_f=False).withColumn("tids", F.array_sort("tids")), "matched_entity_ids")
    return sinks.rewrite_country(old, assignment.assign(p, 0.9, expected_f=False), r, "Brand#2")


QUERIES = {n[2:]: f for n, f in dict(globals()).items() if n.startswith("q_")}

_TID = "CASE WHEN k % 2 = 0 THEN 'S2-' ELSE 'S3-' END || k"
_FIVE = ", ".join(f"round({c}, 6) AS {c}" for c in blocking.CHANNELS)
_WHOLE = {"pf_rank", "num_first_eq", "t_has_num", "t_addr_empty_i", "state_eq", "legal_eq", "t_name_len", "s_name_len", "t_name_ntok", "is_s3", "n_cands", "s1_top1_count"}
_STANDING = """
g AS (SELECT s1, count(*) FILTER (p >= 0.5) AS n5, count(*) FILTER (p >= 0.9) AS n9, sum(p) AS s FROM best GROUP BY s1
), tt AS (SELECT tid, max(p) AS p1, coalesce(max(p) FILTER (rank = 2), 0) AS p2 FROM ranked GROUP BY tid
), q AS (
  SELECT r.*, p1 - p AS p_gap, CASE WHEN rank = 1 THEN p2 ELSE p1 END AS p_best_other, (coalesce(n5, 0) - (rank = 1 AND p >= 0.5)::INT)::INT AS g_n_ex, (coalesce(n9, 0) - (rank = 1 AND p >= 0.9)::INT)::INT AS g_n9_ex,
    coalesce(s, 0) - CASE WHEN rank = 1 THEN p ELSE 0 END AS g_sum_ex, ln(greatest(1e-6, least(1 - 1e-6, p))) - ln(1 - greatest(1e-6, least(1 - 1e-6, p))) AS logit
  FROM ranked r LEFT JOIN g USING (s1) JOIN tt USING (tid) WHERE p >= 0.01
), al AS (SELECT tid, list(g_n_ex ORDER BY g_n_ex DESC) AS l FROM q GROUP BY tid)"""


def _lists_sql(where: str) -> str:
    return f"SELECT s1, string_agg(tid, ',' ORDER BY tid) AS tids FROM best WHERE {where} GROUP BY s1"


def _draw(x: str, seed: int) -> str:
    return f"('0x' || substr(md5({x} || ':{seed}'), 1, 8))::BIGINT"


def _name_pairs(n: str = "nm") -> str:
    return sql.similarities(n, "SELECT t.name AS a, s.name AS b FROM pred JOIN rec t ON pred.k = t.k JOIN rec s ON pred.j = s.k", partial=False)


_F = "CASE WHEN nt = 0 THEN (nm = 0)::INT::DOUBLE WHEN nm = 0 OR tp = 0 THEN 0 ELSE 1.25 * (tp / nm) * (tp / nt) / (0.25 * (tp / nm) + tp / nt) END"
_TRUTH = "tr AS (SELECT 'S1-' || k AS s1, coalesce(list(l.tid) FILTER (l.tid IS NOT NULL), []) AS t FROM rec LEFT JOIN links l ON l.s1 = 'S1-' || k GROUP BY ALL)"


def _prefix(threshold: float) -> str:
    return f"""
acc AS (SELECT *, sum(p) OVER (PARTITION BY s1) AS total, coalesce(sum(CASE WHEN p < {threshold} THEN p END) OVER (PARTITION BY s1), 0) AS miss FROM best
), fk AS (
  SELECT tid, s1, country, p, row_number() OVER w AS k, 1.25 * sum(p) OVER (PARTITION BY s1 ORDER BY p DESC, tid ROWS UNBOUNDED PRECEDING) / (0.25 * total + row_number() OVER w) AS f,
    product(1 - p) OVER (PARTITION BY s1) * exp(-miss) AS f0
  FROM acc WHERE p >= {threshold} WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, tid)
), tp AS (SELECT s1, max(f) AS fmax, arg_max(k, f) AS kbest, any_value(f0) AS f0 FROM fk GROUP BY s1
), kept AS (SELECT fk.* FROM fk JOIN tp USING (s1) WHERE k <= CASE WHEN fmax > tp.f0 THEN kbest ELSE 0 END)"""


def _point(threshold: float, expected_f: bool) -> str:
    kept = _prefix(threshold) if expected_f else f"kept AS (SELECT * FROM best WHERE p >= {threshold})"
    return f"""(WITH {kept}, m AS (SELECT s1, list(tid) AS m FROM kept GROUP BY s1), e AS (SELECT len(t) AS nt, len(coalesce(m, [])) AS nm, len(list_intersect(t, coalesce(m, []))) AS tp FROM tr LEFT JOIN m USING (s1))
      SELECT {threshold}::DOUBLE AS threshold, {str(expected_f).lower()} AS expected_f, round(avg({_F}), 9) AS macro_f05,
        round(avg(CASE WHEN nt = 0 THEN (nm = 0)::INT WHEN nm = 0 THEN 0 ELSE tp / nm END), 9) AS macro_precision, round(avg(CASE WHEN nt = 0 THEN (nm = 0)::INT WHEN nm = 0 THEN 0 ELSE tp / nt END), 9) AS macro_recall FROM e)"""


_VECTORS = """
vp AS (SELECT 'S3-' || vec_id AS tid, 'S1-' || j AS s1, country, (vec_id % 10) / 10.0::DOUBLE AS p FROM (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS j, label::VARCHAR AS country FROM embeddings) WHERE j IS NOT NULL)"""
_RESCUE = f"""{_VECTORS}, op AS (SELECT tid, max(p) AS best_p FROM vp GROUP BY tid HAVING max(p) < 0.7
), dn AS (
  SELECT a.vec_id AS i, b.vec_id AS j, a.label::VARCHAR AS country, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c, best_p
  FROM embeddings a JOIN op ON op.tid = 'S3-' || a.vec_id JOIN embeddings b ON a.label = b.label
), dr AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, 'S1-' || j) AS dense_rank FROM dn QUALIFY dense_rank <= 5
), rn AS (SELECT *, ((i * 31 + j * 17) % 997 + 1) / 999.0::DOUBLE AS ce FROM dr WHERE NOT EXISTS (FROM vp WHERE vp.tid = 'S3-' || i AND vp.s1 = 'S1-' || j)
), {sql.similarities('rs', "SELECT 'name ' || i % 7 AS a, 'name ' || j % 7 AS b FROM rn", partial=False)},
{sql.similarities('ra', "SELECT 'way ' || i % 5 || ' ' || i % 3 AS a, 'way ' || j % 5 || ' ' || j % 3 AS b FROM rn", partial=False)}"""
_FAULTS = """
li AS (SELECT 'S1-' || rec.k AS s1, rec.k, coalesce(string_agg(b.tid, ',' ORDER BY b.tid), '') AS ids FROM rec LEFT JOIN best b ON b.s1 = 'S1-' || rec.k AND b.p >= 0.5 WHERE addr <> '' GROUP BY rec.k
), fi AS (
  SELECT s1, CASE WHEN k % 10 = 0 AND ids <> '' THEN ids || ',' || string_split(ids, ',')[1] WHEN k % 11 = 0 THEN concat_ws(',', nullif(ids, ''), s1) WHEN k % 13 = 0 THEN 'X9,S2-0' ELSE ids END AS ids FROM li
), ex AS (SELECT s1, unnest(string_split(ids, ',')) AS tid FROM fi WHERE ids <> '')"""
_FOUND = "SELECT DISTINCT '{rule}' AS rule, {what} AS x FROM {rows}"

ORACLE_SQL = {
    "similarities": f"""WITH n AS (SELECT DISTINCT p_name FROM part), {sql.similarities('q', 'SELECT x.p_name AS a, y.p_name AS b FROM n x, n y')}
        SELECT a, b, round(ratio, 9) AS ratio, round(sorted, 9) AS sorted, round("set", 9) AS "set", round(partial, 9) AS partial FROM q""",
    "channel_keys": f"WITH {sql.PARTS}, {sql.CHANNELS} SELECT 'S1-' || k AS entity_id, channel, key, tf FROM ktf",
    "channels": f"WITH {sql.PARTS}, {sql.CHANNELS} SELECT {_TID} AS tid, 'S1-' || j AS s1, country, {_FIVE} FROM un",
    "block_union": f"""WITH {sql.PARTS}, {sql.CHANNELS}, {sql.prefiltered(PREFILTER)}
        SELECT {_TID} AS tid, 'S1-' || j AS s1, country, {_FIVE}, round(pf_name, 6) AS pf_name, round(pf_addr, 6) AS pf_addr, round(pf_score, 6) AS pf_score, pf_rank::INT AS pf_rank FROM cand""",
    "pair_features": f"""WITH {sql.PARTS}, {sql.CHANNELS}, {sql.prefiltered(PREFILTER)}, {sql.features()}
        SELECT tid, s1, t_country, {', '.join(c if c in _WHOLE else f'round({c}, 6) AS {c}' for c in pair_features.FEATURES)} FROM feat""",
    "channel_recall": f"""WITH {sql.PARTS}, {sql.CHANNELS}, h AS (SELECT l.tid, {', '.join(f'coalesce({c} > 0, false) AS {c}' for c in blocking.CHANNELS)} FROM links l LEFT JOIN un ON l.tid = {_TID.replace('k', 'un.k')} AND l.s1 = 'S1-' || un.j)
        {' UNION ALL '.join(f"SELECT '{c}' AS channel, round(avg({c}::INT), 9) AS recall, round(avg(({' OR '.join(x for x in blocking.CHANNELS if x != c)})::INT), 9) AS without FROM h" for c in blocking.CHANNELS)}
        UNION ALL SELECT 'union', round(avg(({' OR '.join(blocking.CHANNELS)})::INT), 9), round(avg(({' OR '.join(blocking.CHANNELS)})::INT), 9) FROM h""",
    "group_features": f"""WITH {sql.PARTS}, {_STANDING}, cs AS (SELECT s1, tid AS sib, k AS sk FROM best WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY p DESC, tid) <= 6
        ), sp AS (SELECT p.tid, p.s1, a.name AS an, b.name AS bn, concat_ws(' ', a.addr, a.nums) AS aa, concat_ws(' ', b.addr, b.nums) AS ba, a.nums AS am, b.nums AS bm
          FROM pred p JOIN cs ON p.s1 = cs.s1 AND p.tid <> sib JOIN rec a ON p.k = a.k JOIN rec b ON sk = b.k WHERE p.p >= 0.01
        ), {sql.similarities('s1n', 'SELECT an AS a, bn AS b FROM sp', partial=False)}, {sql.similarities('s2a', 'SELECT aa AS a, ba AS b FROM sp', partial=False)}, {sql.similarities('s3m', 'SELECT am AS a, bm AS b FROM sp', partial=False)}, sf AS (
          SELECT tid, s1, count(*)::INT AS sib_k, max(s2a."set") AS sib_addr_max, avg(s2a."set") AS sib_addr_mean, max(s1n."set") AS sib_name_max, avg(s1n."set") AS sib_name_mean, max(s3m."set") AS sib_num_max, max((aa = ba AND trim(aa) <> '')::INT) AS sib_same_addr
          FROM sp JOIN s1n ON an = s1n.a AND bn = s1n.b JOIN s2a ON aa = s2a.a AND ba = s2a.b JOIN s3m ON am = s3m.a AND bm = s3m.b GROUP BY ALL
        ), sk AS (SELECT country, skel, count(*) AS n FROM rec GROUP BY ALL), nk AS (SELECT country, name, count(*) AS n FROM rec GROUP BY ALL)
        SELECT q.tid, q.s1, q.country, round(p, 6) AS p, round(logit, 6) AS logit, rank::INT AS rank, round(p_gap, 6) AS p_gap, round(p_best_other, 6) AS p_best_other, g_n_ex, g_n9_ex, round(g_sum_ex, 6) AS g_sum_ex,
          coalesce(CASE WHEN l[1] = g_n_ex THEN l[2] ELSE l[1] END, 0)::INT AS alt_g_n, coalesce(sib_k, 0) AS sib_k, round(sib_addr_max, 6) AS sib_addr_max, round(sib_addr_mean, 6) AS sib_addr_mean, round(sib_name_max, 6) AS sib_name_max,
          round(sib_name_mean, 6) AS sib_name_mean, round(sib_num_max, 6) AS sib_num_max, sib_same_addr, sk.n AS s1_skel_freq, nk.n AS s1_name_freq, coalesce(tk.n, 0) AS t_skel_freq, t.addr_empty::INT AS t_addr_empty, (t.nums <> '')::INT AS t_has_num, (q.k % 2)::INT AS is_s3
        FROM q JOIN al USING (tid) JOIN rec t ON q.k = t.k JOIN rec s ON q.j = s.k LEFT JOIN sf ON q.tid = sf.tid AND q.s1 = sf.s1 JOIN sk ON s.country = sk.country AND s.skel = sk.skel JOIN nk ON s.country = nk.country AND s.name = nk.name
        LEFT JOIN sk tk ON t.country = tk.country AND t.skel = tk.skel""",
    "cohesion": f"""WITH {sql.PARTS}, q AS (SELECT *, 1 - p AS n, p * p AS a, p / 4 AS m, rank = 1 AND p >= 0.5 AS own FROM ranked WHERE p >= 0.01
        ), o AS (SELECT *, count(*) FILTER (own) OVER w - own::INT AS others, sum(n) FILTER (own) OVER w AS sn, sum(a) FILTER (own) OVER w AS sa, sum(m) FILTER (own) OVER w AS sm, min(n) FILTER (own) OVER w AS grp_name_min FROM q WINDOW w AS (PARTITION BY s1)
        ), v AS (SELECT *, CASE WHEN others > 0 THEN (sn - CASE WHEN own THEN n ELSE 0 END) / others END AS gn, CASE WHEN others > 0 THEN (sa - CASE WHEN own THEN a ELSE 0 END) / others END AS ga, CASE WHEN others > 0 THEN (sm - CASE WHEN own THEN m ELSE 0 END) / others END AS gm FROM o)
        SELECT tid, s1, round(gn, 9) AS grp_name_to_s1, round(ga, 9) AS grp_addr_to_s1, round(gm, 9) AS grp_num_to_s1, round(grp_name_min, 9) AS grp_name_min, round(p / 2 - gn, 9) AS orphan_name, round(p / 3 - ga, 9) AS orphan_addr, round(n - gn, 9) AS self_vs_grp_name FROM v""",
    "two_scorers": f"""WITH {sql.PARTS}, tt AS (SELECT tid, max(p) AS p1, max(p) FILTER (rank = 2) AS p2 FROM ranked GROUP BY tid
        ), ad AS (SELECT k, addr, nums, CASE WHEN addr = '' THEN 0 ELSE count(*) OVER (PARTITION BY country, addr, nums) END AS an, CASE WHEN addr = '' THEN 0 ELSE count(*) OVER (PARTITION BY country, addr) END AS sn FROM rec)
        SELECT r.tid, r.s1, round(p, 9) AS ce, round(ln(greatest(1e-6, least(1 - 1e-6, p))) - ln(1 - greatest(1e-6, least(1 - 1e-6, p))), 9) AS ce_logit, round(p1 - p, 9) AS ce_gap, rank::INT AS ce_rank,
          round(coalesce(CASE WHEN rank = 1 THEN p2 ELSE p1 END, 0), 9) AS ce_best_other, s.an AS s1_addr_n, s.sn AS s1_street_n, t.an AS t_addr_n, (t.addr <> '' AND t.addr = s.addr AND t.nums = s.nums)::INT AS same_addr,
          CASE WHEN p >= 0.3 THEN round(1 - p, 9) END AS ce2, CASE WHEN p >= 0.3 THEN round(ln(greatest(1e-6, least(1 - 1e-6, 1 - p))) - ln(1 - greatest(1e-6, least(1 - 1e-6, 1 - p))), 9) END AS ce2_logit
        FROM ranked r JOIN tt USING (tid) JOIN ad t ON r.k = t.k JOIN ad s ON r.j = s.k""",
    "gram_cosine": f"""WITH {sql.PARTS}, tx AS (SELECT DISTINCT tid AS id, name || ' | ' || addr AS t FROM pred JOIN rec USING (k) UNION SELECT DISTINCT s1, name || ' | ' || addr FROM pred JOIN rec ON j = rec.k
        ), wd AS (SELECT id, unnest([x FOR x IN regexp_split_to_array(lower(t), '\\s+') IF x <> '']) AS w FROM tx), gr AS (SELECT id, unnest([substr(' ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 1)]) AS g FROM wd
        ), tf AS (SELECT id, g, 1 + ln(count(*)) AS tf FROM gr GROUP BY ALL), df AS (SELECT g, count(*) AS df FROM tf GROUP BY g HAVING count(*) >= 2), nd AS (SELECT count(*) AS docs FROM tx
        ), wt AS (SELECT id, g, tf * (ln((1 + docs) / (1 + df)) + 1) AS w FROM tf JOIN df USING (g), nd), un AS (SELECT id, g, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM wt)
        SELECT p.tid, p.s1, round(coalesce(sum(a.u * b.u), 0), 6) AS ce FROM pred p LEFT JOIN un a ON a.id = p.tid LEFT JOIN un b ON b.id = p.s1 AND b.g = a.g GROUP BY ALL""",
    "normalize_records": """SELECT 'S1-' || s_suppkey AS entity_id, 'IN' AS country, lower(replace(s_name, '#', ' ')) AS name, lower(replace(s_name, '#', '')) AS compact,
        CASE WHEN n_name = 'NATION_12' THEN '12' ELSE '12 ' || n_nationkey END AS nums, false AS addr_empty FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "tune": f"WITH {sql.PARTS}, {_TRUTH} {' UNION ALL '.join(_point(t, e) for e in (False, True) for t in metrics.THRESHOLDS)}",
    "oracle_ceilings": f"""WITH {sql.PARTS}, {_TRUTH}, {_prefix(0.5)}, m AS (SELECT s1, list(tid) AS m FROM kept GROUP BY s1), c AS (SELECT s1, list(tid) AS c FROM pred GROUP BY s1
        ), b AS (SELECT s1, t, coalesce(m, []) AS m, coalesce(c, []) AS c FROM tr LEFT JOIN m USING (s1) LEFT JOIN c USING (s1)
        ), x AS (SELECT '0 as it is' AS change, t, m FROM b UNION ALL SELECT '1 no false links', t, list_intersect(m, t) FROM b UNION ALL SELECT '2 all true candidates', t, list_distinct(list_concat(m, list_intersect(t, c))) FROM b
          UNION ALL SELECT '3 singletons left alone', t, CASE WHEN len(t) > 0 THEN m ELSE [] END FROM b UNION ALL SELECT '4 perfect', t, t FROM b
        ), e AS (SELECT change, len(t) AS nt, len(m) AS nm, len(list_intersect(t, m)) AS tp FROM x) SELECT change, round(avg({_F}), 9) AS macro_f05 FROM e GROUP BY change""",
    "relation_bins": f"""WITH {sql.PARTS}, {_name_pairs()}, {sql.similarities('ad', 'SELECT t.addr AS a, s.addr AS b FROM pred JOIN rec t ON pred.k = t.k JOIN rec s ON pred.j = s.k', partial=False)}
        SELECT tid, s1, concat_ws(' ', CASE WHEN t.name = s.name THEN 'n=exact' WHEN nm."set" >= 0.9 THEN 'n>=90' WHEN nm."set" >= 0.7 THEN 'n70-90' ELSE 'n<70' END,
          CASE WHEN t.addr = '' THEN 'a=empty' WHEN ad."set" >= 0.9 THEN 'a>=90' WHEN ad."set" >= 0.6 THEN 'a60-90' ELSE 'a<60' END,
          CASE WHEN t.nums = '' THEN '#t_none' WHEN s.nums = '' THEN '#s_none' WHEN string_split(t.nums, ' ')[1] = string_split(s.nums, ' ')[1] THEN '#same' WHEN list_has_any(string_split(t.nums, ' '), string_split(s.nums, ' ')) THEN '#shared' ELSE '#diff' END) AS bin
        FROM pred JOIN rec t ON pred.k = t.k JOIN rec s ON pred.j = s.k JOIN nm ON t.name = nm.a AND s.name = nm.b JOIN ad ON t.addr = ad.a AND s.addr = ad.b""",
    "swap_rates": f"""WITH {sql.PARTS}, np AS (SELECT DISTINCT t.name AS a, s.name AS b FROM pred JOIN rec t ON pred.k = t.k JOIN rec s ON pred.j = s.k), wa AS (SELECT a, b, unnest({sql.words('a')}) AS w FROM np), wb AS (SELECT a, b, unnest({sql.words('b')}) AS v FROM np
        ), wr AS (SELECT w, v, {sql.ratio('w', 'v')} >= 0.7 AS near FROM (SELECT DISTINCT w, v FROM wa JOIN wb USING (a, b))
        ), la AS (SELECT a, b, w, bool_or(near) AS near FROM wa JOIN wb USING (a, b) JOIN wr USING (w, v) GROUP BY ALL), lb AS (SELECT a, b, v, bool_or(near) AS near FROM wa JOIN wb USING (a, b) JOIN wr USING (w, v) GROUP BY ALL
        ), sw AS (SELECT np.a, np.b, EXISTS (FROM la WHERE la.a = np.a AND la.b = np.b AND length(w) >= 3 AND NOT near) AND EXISTS (FROM lb WHERE lb.a = np.a AND lb.b = np.b AND length(v) >= 3 AND NOT near) AS swap FROM np)
        SELECT pred.country, count(*) AS n, round(avg(swap::INT), 9) AS swap_rate, round(avg(swap::INT) FILTER (t.addr <> '' AND t.addr = s.addr AND t.nums = s.nums), 9) AS swap_rate_same_addr, round(median(p) FILTER (swap), 9) AS median_p_of_swaps
        FROM pred JOIN rec t ON pred.k = t.k JOIN rec s ON pred.j = s.k JOIN sw ON t.name = sw.a AND s.name = sw.b GROUP BY pred.country""",
    "loosened": f"""WITH {sql.PARTS}, {_name_pairs()}, more AS (SELECT best.tid, best.s1 FROM best JOIN rec t ON best.k = t.k JOIN rec s ON best.j = s.k JOIN nm ON t.name = nm.a AND s.name = nm.b
          WHERE p < 0.6 AND best.country = 'Brand#2' AND (t.addr = s.addr OR t.addr = '') AND nm."set" >= 0.5), l AS (SELECT tid, s1 FROM best WHERE p >= 0.7 UNION ALL FROM more) SELECT s1, string_agg(tid, ',' ORDER BY tid) AS tids FROM l GROUP BY s1""",
    "tightened": f"WITH {sql.PARTS} {_lists_sql("p >= 0.5 AND (country <> 'Brand#2' OR p >= 0.9)")}",
    "neighbourhood": f"""WITH {sql.PARTS}, b AS (SELECT 'S1-' || k AS s1, country, addr, nums FROM rec WHERE country = 'Brand#2'), o AS (SELECT tid, s1 AS owner FROM links)
        SELECT pred.s1, pred.tid, CASE WHEN owner = pred.s1 THEN 'link' WHEN owner IS NULL THEN 'rejected' ELSE 'elsewhere' END AS role, round(p, 9) AS p FROM pred JOIN b USING (s1) LEFT JOIN o ON pred.tid = o.tid
        UNION ALL SELECT b.s1, {_TID} AS tid, 'same address', NULL FROM b JOIN rec USING (country, addr, nums) WHERE addr <> '' AND NOT EXISTS (FROM pred WHERE pred.s1 = b.s1 AND pred.tid = {_TID.replace('k', 'rec.k')})""",
    "native_script": "SELECT role, count(*) AS n, round(avg(regexp_matches(text, '[^\\x00-\\x7F\\x{C0}-\\x{24F}]')::INT), 9) AS share FROM conversations GROUP BY role",
    "auc": f"""WITH {sql.PARTS}, y AS (SELECT round(p, 2) AS x, (l.tid IS NOT NULL)::INT AS y FROM pred LEFT JOIN links l ON pred.tid = l.tid AND pred.s1 = l.s1), g AS (SELECT x, sum(y) AS pos, sum(1 - y) AS neg FROM y GROUP BY x
        ), b AS (SELECT *, sum(neg) OVER (ORDER BY x) - neg / 2 AS below FROM g) SELECT sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives, round(sum(pos * below) / sum(pos) / sum(neg), 9) AS auc FROM b""",
    "describe": f"""WITH {sql.PARTS}, x AS (SELECT 'p_size' AS "column", p_size::DOUBLE AS x FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part UNION ALL SELECT 'p', p FROM pred)
        SELECT "column", count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS q1, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS most FROM x GROUP BY 1""",
    "splits": f"""WITH c AS (SELECT 'S1-' || c_custkey AS s1 FROM customer) SELECT s1, {', '.join(f"({_draw('s1', s)} % {n})::INT AS {c}" for c, s, n in (('fold', models.FOLD_SEED, 2), ('half', models.HALF_SEED, 2), ('tenth', models.STOP_SEED, 10)))},
        {_draw('s1', 123)} / 4294967296.0::DOUBLE < 0.19::DOUBLE AS dropped FROM c""",
    "samples": f"""SELECT c_custkey, c_nationkey, 'all' AS kind FROM customer QUALIFY row_number() OVER (ORDER BY {_draw('c_custkey', 0)}, c_custkey) <= 50
        UNION ALL SELECT c_custkey, c_nationkey, 'each' FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {_draw('c_custkey', 3)}, c_custkey) <= 5""",
    "validation_split": f"""WITH {sql.PARTS}, u AS (SELECT 'S1-' || k AS s1 FROM rec), held AS (SELECT s1 FROM u WHERE {_draw('s1', 42)} / 4294967296.0::DOUBLE < 0.1::DOUBLE AND NOT {_draw('s1', 123)} / 4294967296.0::DOUBLE < 0.19::DOUBLE
        ), touched AS (SELECT DISTINCT tid FROM pred JOIN held USING (s1)), linked AS (SELECT tid FROM links JOIN held USING (s1))
        SELECT s1 AS id, 'held' AS part FROM held UNION ALL SELECT tid, 'touched' FROM touched UNION ALL SELECT DISTINCT tid, 'pool' FROM pred WHERE tid NOT IN (FROM touched) AND tid NOT IN (FROM linked)""",
    "set_operations": """SELECT c_custkey AS k, 'semi' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL (SELECT k, 'union' FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0))
        UNION ALL (SELECT o_orderkey, 'head' FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)""",
    "rescue": f"""WITH {_RESCUE} SELECT 'S3-' || i AS tid, 'S1-' || j AS s1, country, round(ce, 6) AS ce, round(ln(ce) - ln(1 - ce), 6) AS ce_logit, round(c, 6) AS dense_cos, dense_rank::INT AS dense_rank, round(rs."set", 6) AS pf_name, round(ra."set", 6) AS pf_addr, round(best_p, 6) AS best_p,
        (row_number() OVER (PARTITION BY i ORDER BY ce DESC, 'S1-' || j))::INT AS ce_rank_t, round(max(ce) OVER (PARTITION BY i), 6) AS ce_max_t, round(max(ce) OVER (PARTITION BY i) - ce, 6) AS ce_gap_t, (count(*) OVER (PARTITION BY i))::INT AS n_resc, 1 AS is_s3
        FROM rn JOIN rs ON rs.a = 'name ' || i % 7 AND rs.b = 'name ' || j % 7 JOIN ra ON ra.a = 'way ' || i % 5 || ' ' || i % 3 AND ra.b = 'way ' || j % 5 || ' ' || j % 3""",
    "merge_rescue": f"WITH {_RESCUE} SELECT tid, s1, country, round(p, 6) AS p FROM vp UNION ALL SELECT 'S3-' || i, 'S1-' || j, country, round(ce, 6) FROM rn WHERE country <> '3'",
    "solo": """WITH d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label::VARCHAR AS country, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label)
        SELECT 'S2-' || i AS tid, 'S1-' || j AS s1, country, round(1 / (1 + exp(-(8.0::DOUBLE * c - 4))), 6) AS p FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, 'S1-' || j) <= 8""",
    "widen": f"""WITH {sql.PARTS}, bp AS (SELECT tid, k, max(p) / 40 AS p1 FROM pred GROUP BY ALL), rt AS (SELECT count(*) FILTER (k % 2 = 0 AND p1 >= 0.01) AS n, count(*) FILTER (k % 6 = 0) AS b FROM bp
        ), quiet AS (SELECT tid FROM bp, rt WHERE k % 2 = 0 AND p1 < 0.01 AND k % 11 <> 0 AND {_draw('tid', 342)} / 4294967296.0::DOUBLE * n < b
        ), rest AS (SELECT tid FROM bp WHERE p1 < 0.5 AND k % 11 <> 0 AND k % 6 <> 0 AND tid NOT IN (FROM quiet) AND {_draw('tid', 442)} / 4294967296.0::DOUBLE < 0.5)
        SELECT tid, 'val' AS part FROM rest WHERE tid IN (SELECT tid FROM pred WHERE j % 7 = 0) UNION ALL SELECT tid, 'B' FROM quiet""",
    "tsv_records": """WITH d AS (SELECT 'S1-' || s_suppkey AS entity_id, '"' || s_name || '" & co' AS business_name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS business_address, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT *, 'all' AS kind FROM d UNION ALL SELECT entity_id, business_name, '', '', 'listed' FROM d WHERE business_address <> '' AND country < 'NATION_2'""",
    "quoted_tsv": "SELECT s_suppkey::VARCHAR AS id, s_name || chr(9) || 'x' AS name FROM supplier",
    "stage": "SELECT n_nationkey, n_name, n_regionkey AS region FROM nation",
    "json_and_csv": "SELECT r_regionkey, r_name, 0.5::DOUBLE AS threshold, true AS expected_f FROM region",
    "line_scan": f"WITH {sql.PARTS}, {_FAULTS} SELECT s1, ids FROM fi",
    "validate": f"""WITH {sql.PARTS}, {_FAULTS}, f AS (
        {_FOUND.format(rule='repeated id in a list', what='s1', rows="fi WHERE ids <> '' AND len(string_split(ids, ',')) <> len(list_distinct(string_split(ids, ',')))")} UNION ALL {_FOUND.format(rule='self match', what='tid', rows="ex WHERE starts_with(tid, 'S1-')")}
        UNION ALL {_FOUND.format(rule='wrong prefix', what='tid', rows="ex WHERE NOT regexp_matches(tid, '^S[123]-')")} UNION ALL {_FOUND.format(rule='missing record', what="'S1-' || k", rows="rec WHERE addr = ''")}
        UNION ALL {_FOUND.format(rule='unknown id', what='tid', rows=f"ex WHERE regexp_matches(tid, '^S[23]-') AND tid NOT IN (SELECT {_TID} FROM rec WHERE addr <> '')")})
        SELECT 'matched_entity_ids: ' || rule AS rule, 'error' AS severity, count(*) AS n, array_to_string(list(x ORDER BY x)[1:5], ',') AS examples FROM f GROUP BY rule""",
    "rewrite_country": f"""WITH {sql.PARTS} SELECT 'S1-' || rec.k AS source1_entity_id, coalesce(string_agg(b.tid, ',' ORDER BY b.tid), '') AS matched_entity_ids
        FROM rec LEFT JOIN best b ON b.s1 = 'S1-' || rec.k AND b.p >= CASE WHEN rec.country = 'Brand#2' THEN 0.9 ELSE 0.5 END GROUP BY rec.k""",
}
