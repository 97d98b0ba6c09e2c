"""The registered queries of the resolution operators over the driver's tables, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import oracle_text, pair_queries
from recordloom.functions import text
from recordloom.operators import assignment, blocking, diagnostics, group_features, metrics, name_pairs, pair_features, rescue, splits, vectors
from recordloom.sources import sinks, tables

PREFILTER = pair_queries.PREFILTER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r9(c: Column | str) -> Column:
    return F.round(c, 9)


# ---------------------------------------------------------------- inputs, and the same in SQL


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All record names of the star schema: source, name."""
    out = None
    for t, c in (("part", "p_name"), ("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"), ("pages", "url")):
        d = table(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(c).alias("raw"))
        out = d if out is None else out.unionByName(d)
    return out


def documents_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as normalized records: the language is the country, the text's ASCII words the name."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), F.col("lang").alias("country"), plain.alias("name"), F.col("source").alias("addr"), F.col("n_chars").cast("string").alias("nums"))
    return d.withColumns({"skel": F.col("name"), "compact": F.replace("name", F.lit(" "), F.lit("")), "state": F.lit(""), "legal": F.lit(""), "addr_empty": F.lit(False)})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair scores made by integer arithmetic: orders are targets, suppliers reference records, the customer's nation the country."""
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    pairs = li.select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    pairs = pairs.join(o, F.col("o") == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"])
    p = (F.pmod(F.col("o") * 7919 + F.col("s") * 104729, F.lit(9973)) + 1) / 9975.0
    return pairs.select(F.concat(F.lit("S2-"), F.col("o")).alias("tid"), F.concat(F.lit("S1-"), F.col("s")).alias("s1"), F.col("n_name").alias("country"), p.alias("p"))


def true_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order truly belongs to the supplier of its first line."""
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_linenumber = 1").select(F.concat(F.lit("S2-"), F.col("l_orderkey")).alias("tid"), F.concat(F.lit("S1-"), F.col("l_suppkey")).alias("s1")).distinct()


def true_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S1-"), F.col("s_suppkey")).alias("s1"))
    t = true_links(spark, sf_dir).groupBy("s1").agg(F.collect_list("tid").alias("tids"))
    return s.join(t, "s1", "left").select("s1", F.coalesce("tids", F.array().cast("array<string>")).alias("tids"))


PRED = """
pred AS (
  SELECT 'S2-' || o AS tid, 'S1-' || s AS s1, n_name AS country, ((o * 7919 + s * 104729) % 9973 + 1) / 9975.0::DOUBLE AS p
  FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) JOIN orders ON o = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), ranked AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY p DESC, s1) AS rank FROM pred
), best AS (SELECT * FROM ranked WHERE rank = 1
), links AS (SELECT DISTINCT 'S2-' || l_orderkey AS tid, 'S1-' || l_suppkey AS s1 FROM lineitem WHERE l_linenumber = 1
), reference AS (SELECT 'S1-' || s_suppkey AS s1, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""
PREFIX = """
acc AS (
  SELECT *, sum(p) OVER (PARTITION BY s1) AS total, coalesce(sum(CASE WHEN p < 0.5 THEN p END) OVER (PARTITION BY s1), 0) AS miss FROM best
), fk AS (
  SELECT tid, s1, country, p, total, row_number() OVER w AS k,
    1.25 * sum(p) OVER (PARTITION BY s1 ORDER BY p DESC, tid ROWS UNBOUNDED PRECEDING) / (0.25 * total + row_number() OVER w) AS f,
    product(1 - p) OVER (PARTITION BY s1) * exp(-miss) AS f0
  FROM acc WHERE p >= 0.5 WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, tid)
), top AS (SELECT s1, max(f) AS fmax, arg_max(k, f) AS kbest, any_value(f0) AS f0 FROM fk GROUP BY s1
), keep AS (SELECT s1, fmax, f0, CASE WHEN fmax > f0 THEN kbest ELSE 0 END AS keep FROM top
), kept AS (SELECT fk.* FROM fk JOIN keep USING (s1) WHERE k <= keep
)"""
LISTS = """
m AS (SELECT s1, list(tid ORDER BY tid) AS m FROM kept GROUP BY s1
), t AS (SELECT r.s1, r.country, coalesce(list(l.tid) FILTER (l.tid IS NOT NULL), []) AS t FROM reference r LEFT JOIN links l USING (s1) GROUP BY ALL
), c AS (SELECT s1, list(tid) AS c FROM pred GROUP BY s1
), e AS (
  SELECT s1, country, len(t) AS nt, len(coalesce(m, [])) AS nm, len(list_intersect(t, coalesce(m, []))) AS tp,
    len(list_intersect(t, coalesce(c, []))) AS tc, len(coalesce(c, [])) AS nc
  FROM t LEFT JOIN m USING (s1) LEFT JOIN c USING (s1)
), pr AS (
  SELECT *, CASE WHEN nt = 0 THEN (nm = 0)::INT::DOUBLE WHEN nm = 0 THEN 0 ELSE tp / nm END AS p,
    CASE WHEN nt = 0 THEN (nm = 0)::INT::DOUBLE WHEN nm = 0 THEN 0 ELSE tp / nt END AS r
  FROM e
), sc AS (SELECT *, CASE WHEN p * r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0 END AS f FROM pr
)"""
SCORES = """round(avg(f), 9) AS macro_f05, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, count(*) AS entities,
  sum((nt = 0)::INT)::BIGINT AS singletons, round(CASE WHEN sum((nt = 0)::INT) > 0 THEN sum((nt = 0 AND nm = 0)::INT) / sum((nt = 0)::INT) ELSE 1 END, 9) AS singleton_accuracy,
  round(coalesce(avg(CASE WHEN nt > 0 THEN tc / nt END), 0), 9) AS candidate_recall_ceiling, round(avg(nc), 9) AS avg_candidates_per_entity"""
KEYS = r"""
d AS (
  SELECT doc_id::VARCHAR AS id, lang AS country, [x FOR x IN string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') IF x <> ''] AS w FROM documents
), raw AS (
  SELECT id, country, unnest([x FOR x IN w IF len(x) >= 2]) AS key FROM d
  UNION ALL SELECT id, country, unnest([w[i] || '_' || w[i + 1] FOR i IN range(1, greatest(len(w), 1))]) FROM d
  UNION ALL SELECT id, country, 'P:' || substr(array_to_string(w, ''), 1, 6) FROM d WHERE len(array_to_string(w, '')) >= 6
), tf AS (SELECT id, country, key, count(*) AS tf FROM raw GROUP BY ALL
), idf AS (
  SELECT country, key, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT country, key, count(*) AS df FROM tf GROUP BY ALL) JOIN (SELECT country, count(DISTINCT id) AS n FROM tf GROUP BY country) USING (country)
  WHERE df <= 200
), wt AS (SELECT id, country, key, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS w FROM tf JOIN idf USING (country, key)
), cos AS (SELECT a.id AS tid, b.id AS s1, a.country, sum(a.w * b.w) AS cos FROM wt a JOIN wt b USING (country, key) GROUP BY ALL HAVING sum(a.w * b.w) > 0.05
)"""


# ---------------------------------------------------------------- queries


def q_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct ASCII word of the documents and its skeleton."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.words(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")))).alias("word")).distinct()
    return w.select("word", text.skeleton_token(F.col("word")).alias("skel"))


def q_normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).groupBy("source", "raw").agg(F.count(F.lit(1)).alias("n")).withColumn("x", text.normalize_name(F.col("raw"))).select("source", "raw", "n", "x.name", "x.legal", "x.skel")


def q_normalize_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses and document texts as raw addresses."""
    d = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("raw"), F.lit("US").alias("country"))
    d = d.unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("raw"), F.when(F.col("lang") == "fr", "France").otherwise(F.upper("lang")).alias("country")))
    return d.withColumn("x", text.normalize_address(F.col("raw"), F.col("country"))).select("id", "country", "x.*")


def q_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel: key frequencies under the cut, with their weights."""
    d = documents_as_records(spark, sf_dir)
    keys = d.select("entity_id", "country", F.lit("name_key").alias("channel"), F.explode(blocking.name_keys(F.col("name"))).alias("key")).groupBy("entity_id", "country", "channel", "key").agg(F.count(F.lit(1)).alias("tf"))
    return blocking.key_weights(keys).select("country", "key", r9("idf").alias("idf"))


def q_block_name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel of blocking, documents against documents: cosine of weighted keys, ten best."""
    from pyspark.sql import Window

    d = documents_as_records(spark, sf_dir)
    cos = blocking.best_within(d.select("entity_id", "country", blocking.name_keys(F.col("name")).alias("keys")))
    order = Window.partitionBy("tid").orderBy(F.desc(F.round("cos", 8)), "s1")
    return cos.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= blocking.TOP_K).select("tid", "s1", "country", F.round("cos", 6).alias("cos"), "rank")


def q_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier names of the same nation."""
    side = lambda t, p, key: table(spark, sf_dir, t).select(F.col(f"{p}_nationkey").alias("group"), F.col(key).alias("key"), F.col(f"{p}_name").alias("name"))
    d = name_pairs.jaro_winkler_pairs(side("customer", "c", "c_custkey"), side("supplier", "s", "s_suppkey"), 6)
    return d.select(F.col("a").alias("c_custkey"), F.col("b").alias("s_suppkey"), "jw")


def q_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the next of its source: shared words and their share."""
    from pyspark.sql import Window

    d = documents_as_records(spark, sf_dir).select(F.col("entity_id").cast("long").alias("id"), "addr", "name")
    w = Window.partitionBy("addr").orderBy("id")
    d = d.withColumns({"next": F.lead("id").over(w), "other": F.lead("name").over(w)}).where("next is not null")
    shared, share = pair_features.overlap(F.col("name"), F.col("other"))
    return d.select("id", "next", shared.cast("long").alias("shared"), r9(share).alias("share"))


def q_rank_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefilter's logit over channel scores made of order lines, eight best for each order."""
    p = predictions(spark, sf_dir)
    d = p.select("tid", "s1", "country", *[(F.pmod(F.floor(F.col("p") * 9975 * (i + 3)), F.lit(101)) / 100.0).alias(f) for i, f in enumerate(blocking.PREFILTER_FEATURES)])
    return blocking.rank_candidates(d, PREFILTER, digits=None).select("tid", "s1", r9("pf_score").alias("pf_score"), "pf_rank")


def q_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = group_features.standing(predictions(spark, sf_dir))
    return d.select("tid", "s1", "rank", r9("p_gap").alias("p_gap"), r9("p_best_other").alias("p_best_other"), "g_n_ex", "g_n9_ex", r9("g_sum_ex").alias("g_sum_ex"), "alt_g_n", r9("logit").alias("logit"))


def q_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-join: each pair in play with the confident members of its record's group."""
    return group_features.sibling_pairs(predictions(spark, sf_dir)).groupBy("tid", "s1").agg(F.count(F.lit(1)).alias("k"), F.min("sib").alias("first"))


def q_score_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = group_features.score_standing(predictions(spark, sf_dir).withColumnRenamed("p", "ce"))
    return d.select("tid", "s1", r9("ce_gap").alias("ce_gap"), "ce_rank", r9("ce_best_other").alias("ce_best_other"), r9("ce_logit").alias("ce_logit"))


def q_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, segment and balance sign as addresses."""
    c = table(spark, sf_dir, "customer")
    d = c.select(F.concat(F.lit("S1-"), "c_custkey").alias("entity_id"), F.col("c_nationkey").cast("string").alias("country"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("addr"), F.floor(F.col("c_acctbal") / 1000).cast("string").alias("nums"))
    s, _ = group_features.address_crowding(d, d)
    return s.select("s1", "s1_addr_n", "s1_street_n")


def q_name_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents paired with the next of their source and language: weighted overlap of words."""
    from pyspark.sql import Window

    d = documents_as_records(spark, sf_dir)
    pairs = d.select(F.col("entity_id").alias("tid"), F.lead("entity_id").over(Window.partitionBy("addr", "country").orderBy(F.col("entity_id").cast("long"))).alias("s1"), "country").where("s1 is not null")
    return group_features.add_name_weights(pairs, d, d).select("tid", "s1", *[r9(c).alias(c) for c in group_features.NAME_FEATURES])


def q_best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.best_links(predictions(spark, sf_dir)).select("tid", "s1", "country", r9("p").alias("p"))


def q_expected_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = assignment.expected_prefixes(predictions(spark, sf_dir), 0.5)
    return d.select("tid", "s1", "k", r9("f").alias("f"), r9("f0").alias("f0"), "keep")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.assign(predictions(spark, sf_dir), 0.5)


def q_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("s1", F.array_join("tids", ",").alias("tids"))


def q_assign_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.assign(predictions(spark, sf_dir), 0.7, expected_f=False).select("s1", F.array_join("tids", ",").alias("tids"))


def q_country_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with suppliers are the seen countries."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    seen = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("country"))
    return assignment.country_thresholds(predictions(spark, sf_dir), 0.4, seen, {"NATION_3": 0.9}).select("country", r9("rate").alias("rate"), "threshold")


def _scores(d: DataFrame) -> DataFrame:
    return d.withColumns({c: r9(c) for c, t in d.dtypes if t == "double"})


def q_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = predictions(spark, sf_dir).groupBy("s1").agg(F.collect_list("tid").alias("tids"))
    return _scores(metrics.evaluate(true_lists(spark, sf_dir), matches(spark, sf_dir), cands))


def q_evaluate_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = predictions(spark, sf_dir).groupBy("s1").agg(F.collect_list("tid").alias("tids"))
    return _scores(metrics.evaluate(true_lists(spark, sf_dir), matches(spark, sf_dir), cands, suppliers(spark, sf_dir)))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("S1-"), "s_suppkey").alias("s1"), F.col("n_name").alias("country"))


def q_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diagnostics.kind_shares(diagnostics.error_kinds(true_links(spark, sf_dir), predictions(spark, sf_dir), matches(spark, sf_dir), 0.5))
    return d.select("kind", "n", r9("share").alias("share"))


def q_false_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.false_links(matches(spark, sf_dir), true_links(spark, sf_dir)).select("tid", "s1", "owned")


def q_expected_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    targets = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("country"))
    return _scores(diagnostics.expected_by_country(predictions(spark, sf_dir), 0.5, suppliers(spark, sf_dir).withColumnRenamed("s1", "entity_id"), targets))


def q_band_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diagnostics.band_shares(predictions(spark, sf_dir))
    return d.select("country", *[F.coalesce(r9(F.col(f"`{c}`")), F.lit(0.0)).alias(f"b{i}") for i, c in enumerate(d.columns[1:])])


def q_false_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(diagnostics.false_share_expected(predictions(spark, sf_dir), 0.5))


def q_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(diagnostics.calibration(assignment.best_links(predictions(spark, sf_dir)), true_links(spark, sf_dir)))


def q_compare_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities of finished against open orders."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "bin")
    return _scores(diagnostics.compare_shares(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")))


def q_drop_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt are dropped; ranks are counted anew."""
    dropped = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("S1-"), "s_suppkey").alias("s1"))
    d = splits.without_dropped(predictions(spark, sf_dir).withColumnRenamed("p", "pf_score"), dropped)
    return d.select("tid", "s1", r9("pf_score").alias("pf_score"), "pf_rank")


def q_top1_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = splits.without_dropped(predictions(spark, sf_dir).withColumnRenamed("p", "pf_score"), spark.createDataFrame([], "s1 string"))
    return pair_features.with_context(d).select("tid", "s1", "pf_rank", "s1_top1_count")


def q_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second stage squares the probability of pairs in play."""
    p = predictions(spark, sf_dir)
    second = p.where("p >= 0.3").select("tid", "s1", (F.col("p") * F.col("p")).alias("p2"))
    return group_features.rescore(p, second).select("tid", "s1", r9("p").alias("p"))


def q_open_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(rescue.open_targets(predictions(spark, sf_dir)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), F.col("label").cast("string").alias("country"), "embedding")


def q_dense_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's five nearest others of its label."""
    v = _vectors(spark, sf_dir)
    d = vectors.dense_top_k(v, v, 5, exclude_same=True)
    return d.select("tid", "s1", "country", F.round("dense_cos", 6).alias("dense_cos"), "dense_rank")


def q_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector truly belongs to any vector whose id is within twenty of its own."""
    v = _vectors(spark, sf_dir)
    near = vectors.dense_top_k(v, v, 5, exclude_same=True)
    links = near.where(F.abs(F.col("tid").cast("long") - F.col("s1").cast("long")) <= 20).select("tid", "s1")
    return _scores(rescue.gate_report(near, links))


def q_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result table: a row for each supplier, its orders by number."""
    return sinks.id_lists(suppliers(spark, sf_dir).withColumnRenamed("s1", "entity_id"), matches(spark, sf_dir).select("s1", F.sort_array("tids").alias("tids")), "matched_entity_ids")


def q_truth_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-joined lists and back."""
    d = true_lists(spark, sf_dir).select("s1", F.array_join("tids", ",").alias("matched_entity_ids"))
    return tables.truth_links(d)


def q_resolve_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents block each other by name keys, each takes its best other, and lists follow the expected score."""
    d = q_block_name_key(spark, sf_dir).where("tid <> s1").select("tid", "s1", "country", F.least(F.col("cos"), F.lit(0.999)).alias("p"))
    return assignment.assign(d, 0.3).select("s1", F.array_join("tids", ",").alias("tids"))


QUERIES = {n[2:]: f for n, f in dict(globals()).items() if n.startswith("q_")} | pair_queries.QUERIES

TEXT_WORDS = r"[x FOR x IN string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') IF x <> '']"
ORACLE_SQL = {
    "skeleton": f"SELECT word, {oracle_text.skeleton_sql('word')} AS skel FROM (SELECT DISTINCT unnest({TEXT_WORDS}) AS word FROM documents)",
    "normalize_names": oracle_text.names_sql(),
    "normalize_addresses": oracle_text.addresses_sql(),
    "name_keys": f"WITH {KEYS} SELECT country, key, round(idf, 9) AS idf FROM idf",
    "block_name_key": f"""WITH {KEYS} SELECT tid, s1, country, round(cos, 6) AS cos, r::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY round(cos, 8) DESC, s1) AS r FROM cos) WHERE r <= 10""",
    "jaro_winkler": "SELECT c_custkey, s_suppkey, round(jaro_winkler_similarity(c_name, s_name), 6) AS jw FROM customer JOIN supplier ON c_nationkey = s_nationkey",
    "token_overlap": f"""WITH d AS (SELECT doc_id AS id, source, list_distinct({TEXT_WORDS}) AS w FROM documents),
        n AS (SELECT id, w, lead(id) OVER o AS next, lead(w) OVER o AS v FROM d WINDOW o AS (PARTITION BY source ORDER BY id))
        SELECT id, next, len(list_intersect(w, v))::BIGINT AS shared,
          round(len(list_intersect(w, v)) / greatest(len(list_distinct(list_concat(w, v))), 1), 9) AS share FROM n WHERE next IS NOT NULL""",
    "rank_top8": f"""WITH {PRED}, f AS (SELECT tid, s1, {', '.join(f"(floor(p * 9975 * {i + 3})::BIGINT % 101) / 100.0::DOUBLE AS f{i}" for i in range(7))} FROM pred),
        g AS (SELECT tid, s1, -2.5::DOUBLE + {' + '.join(f"{c}::DOUBLE * f{i}" for i, c in enumerate(PREFILTER['coef']))} AS score FROM f),
        h AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY score DESC, s1) AS r FROM g) SELECT tid, s1, round(score, 9) AS pf_score, r::INT AS pf_rank FROM h WHERE r <= 8""",
    "standing": f"""WITH {PRED}, g AS (SELECT s1, count(*) FILTER (p >= 0.5) AS n5, count(*) FILTER (p >= 0.9) AS n9, sum(p) AS s FROM best GROUP BY s1),
        t AS (SELECT tid, max(p) AS p1, coalesce(max(p) FILTER (rank = 2), 0) AS p2 FROM ranked GROUP BY tid),
        q AS (SELECT r.*, p1, p2, (coalesce(n5, 0) - (rank = 1 AND p >= 0.5)::INT)::INT AS g_n_ex, (coalesce(n9, 0) - (rank = 1 AND p >= 0.9)::INT)::INT AS g_n9_ex,
          coalesce(s, 0) - CASE WHEN rank = 1 THEN p ELSE 0 END AS gs FROM ranked r LEFT JOIN g USING (s1) JOIN t USING (tid) WHERE p >= 0.01),
        a AS (SELECT tid, list(g_n_ex ORDER BY g_n_ex DESC) AS l FROM q GROUP BY tid)
        SELECT tid, s1, rank::INT AS rank, round(p1 - p, 9) AS p_gap, round(CASE WHEN rank = 1 THEN p2 ELSE p1 END, 9) AS p_best_other, g_n_ex, g_n9_ex, round(gs, 9) AS g_sum_ex,
          coalesce(CASE WHEN l[1] = g_n_ex THEN l[2] ELSE l[1] END, 0)::INT AS alt_g_n, round(ln(greatest(1e-6, least(1 - 1e-6, p))) - ln(1 - greatest(1e-6, least(1 - 1e-6, p))), 9) AS logit
        FROM q JOIN a USING (tid)""",
    "siblings": f"""WITH {PRED}, c AS (SELECT s1, tid AS sib, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, tid) AS k FROM best WHERE p >= 0.5)
        SELECT p.tid, p.s1, count(*) AS k, min(sib) AS first FROM pred p JOIN c ON p.s1 = c.s1 AND p.tid <> sib WHERE p >= 0.01 AND k <= 6 GROUP BY ALL""",
    "score_standing": f"""WITH {PRED}, t AS (SELECT tid, max(p) AS p1, max(p) FILTER (rank = 2) AS p2 FROM ranked GROUP BY tid)
        SELECT tid, s1, round(p1 - p, 9) AS ce_gap, rank::INT AS ce_rank, round(coalesce(CASE WHEN rank = 1 THEN p2 ELSE p1 END, 0), 9) AS ce_best_other,
          round(ln(greatest(1e-6, least(1 - 1e-6, p))) - ln(1 - greatest(1e-6, least(1 - 1e-6, p))), 9) AS ce_logit FROM ranked JOIN t USING (tid)""",
    "crowding": """WITH d AS (SELECT 'S1-' || c_custkey AS s1, c_nationkey AS c, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS a, floor(c_acctbal / 1000)::BIGINT AS n FROM customer)
        SELECT s1, CASE WHEN a IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY c, a, n) END AS s1_addr_n, CASE WHEN a IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY c, a) END AS s1_street_n FROM d""",
    "name_weights": f"""WITH d AS (SELECT doc_id AS id, source, lang, list_distinct({TEXT_WORDS}) AS w FROM documents),
        n AS (SELECT lang, ln(count(*)::DOUBLE) AS top, count(*) AS n FROM d GROUP BY lang), df AS (SELECT lang, tok, count(*) AS df FROM (SELECT lang, unnest(w) AS tok FROM d) GROUP BY ALL),
        idf AS (SELECT lang, tok, ln(n / df) AS idf FROM df JOIN n USING (lang)),
        p AS (SELECT id AS tid, w AS tw, lang, lead(id) OVER o AS s1, lead(w) OVER o AS sw FROM d WINDOW o AS (PARTITION BY source, lang ORDER BY id)),
        s AS (SELECT tid, s1, lang, unnest(sw) AS tok, 1 AS side FROM p WHERE s1 IS NOT NULL), t AS (SELECT tid, s1, lang, unnest(tw) AS tok FROM p WHERE s1 IS NOT NULL),
        j AS (SELECT coalesce(s.tid, t.tid) AS tid, coalesce(s.s1, t.s1) AS s1, coalesce(s.lang, t.lang) AS lang, coalesce(s.tok, t.tok) AS tok, s.tid IS NOT NULL AS ins, t.tid IS NOT NULL AS int
          FROM s FULL JOIN t ON s.tid = t.tid AND s.s1 = t.s1 AND s.tok = t.tok),
        g AS (SELECT tid, s1, coalesce(sum(idf) FILTER (ins), 0) AS ws, coalesce(sum(idf) FILTER (int), 0) AS wt, coalesce(sum(idf) FILTER (ins AND int), 0) AS wb,
          coalesce(max(idf) FILTER (ins AND NOT int), 0) AS a, coalesce(max(idf) FILTER (int AND NOT ins), 0) AS b FROM j JOIN idf USING (lang, tok) GROUP BY ALL)
        SELECT p.tid::VARCHAR AS tid, p.s1::VARCHAR AS s1, round(CASE WHEN ws + wt - wb <> 0 THEN wb / (ws + wt - wb) ELSE 0 END, 9) AS name_idf_jac, round(CASE WHEN ws <> 0 THEN wb / ws ELSE 0 END, 9) AS s_idf_cov,
          round(coalesce(a, 0), 9) AS s_missing_max, round(coalesce(b, 0), 9) AS t_extra_max FROM p LEFT JOIN g ON p.tid = g.tid AND p.s1 = g.s1 WHERE p.s1 IS NOT NULL""",
    "best_links": f"WITH {PRED} SELECT tid, s1, country, round(p, 9) AS p FROM best",
    "expected_prefix": f"WITH {PRED}, {PREFIX} SELECT tid, s1, k::INT AS k, round(f, 9) AS f, round(fk.f0, 9) AS f0, keep::INT AS keep FROM fk JOIN keep USING (s1)",
    "assign": f"WITH {PRED}, {PREFIX} SELECT s1, string_agg(tid, ',' ORDER BY p DESC, tid) AS tids FROM kept GROUP BY s1",
    "assign_threshold": f"WITH {PRED} SELECT s1, string_agg(tid, ',' ORDER BY p DESC, tid) AS tids FROM best WHERE p >= 0.7 GROUP BY s1",
    "country_thresholds": f"""WITH {PRED} SELECT country, round(avg((p >= 0.4)::INT), 9) AS rate,
        CASE WHEN country = 'NATION_3' THEN 0.9::DOUBLE WHEN country IN (SELECT country FROM reference) THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS threshold FROM best GROUP BY country""",
    "evaluate": f"WITH {PRED}, {PREFIX}, {LISTS} SELECT {SCORES} FROM sc",
    "evaluate_by_country": f"WITH {PRED}, {PREFIX}, {LISTS} SELECT country, {SCORES} FROM sc GROUP BY country",
    "error_kinds": f"""WITH {PRED}, {PREFIX}, k AS (SELECT CASE WHEN p.tid IS NULL THEN '1 blocking miss' WHEN kept.tid IS NOT NULL THEN '0 found' WHEN b.s1 <> l.s1 THEN '2 another ranked higher'
        WHEN b.p < 0.5 THEN '3 best, below threshold' ELSE '4 best, cut by expected F' END AS kind
        FROM links l LEFT JOIN pred p ON l.tid = p.tid AND l.s1 = p.s1 LEFT JOIN best b ON l.tid = b.tid LEFT JOIN kept ON l.tid = kept.tid AND l.s1 = kept.s1)
        SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM k GROUP BY kind""",
    "false_links": f"WITH {PRED}, {PREFIX} SELECT tid, s1, tid IN (SELECT tid FROM links) AS owned FROM kept WHERE NOT EXISTS (FROM links l WHERE l.tid = kept.tid AND l.s1 = kept.s1)",
    "expected_by_country": f"""WITH {PRED}, {PREFIX}, a AS (SELECT s1, sum(p) AS total FROM best GROUP BY s1),
        d AS (SELECT r.country, coalesce(greatest(fmax, f0), exp(-total), 1) AS ef, coalesce(keep, 0) AS keep FROM reference r LEFT JOIN keep USING (s1) LEFT JOIN a USING (s1)),
        n AS (SELECT n_name AS country, count(*) AS targets FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
        g AS (SELECT country, count(*) AS s1, avg(ef) AS e, avg((keep = 0)::INT) AS z, sum(keep)::BIGINT AS links FROM d GROUP BY country)
        SELECT country, s1, round(e, 9) AS expected_f05, round(z, 9) AS empty_rate, links, round(links / s1, 9) AS links_per_s1, round(links / targets, 9) AS linked_target_share, round(targets / s1, 9) AS targets_per_s1 FROM g JOIN n USING (country)""",
    "band_shares": f"""WITH {PRED} SELECT country, round(avg((p <= 0.1)::INT), 9) AS b0, round(avg((p > 0.1 AND p <= 0.5)::INT), 9) AS b1, round(avg((p > 0.5 AND p <= 0.9)::INT), 9) AS b2,
        round(avg((p > 0.9 AND p <= 0.99)::INT), 9) AS b3, round(avg((p > 0.99)::INT), 9) AS b4 FROM best GROUP BY country""",
    "false_share": f"WITH {PRED} SELECT country, round(avg(1 - p), 9) AS expected_false_share FROM best WHERE p >= 0.5 GROUP BY country",
    "calibration": f"""WITH {PRED}, b AS (SELECT best.*, CASE WHEN p >= 0.8 THEN 0.8 WHEN p >= 0.7 THEN 0.7 WHEN p >= 0.6 THEN 0.6 WHEN p >= 0.5 THEN 0.5 WHEN p >= 0.4 THEN 0.4 WHEN p >= 0.3 THEN 0.3 END::DOUBLE AS band,
        (l.tid IS NOT NULL)::INT AS y FROM best LEFT JOIN links l ON best.tid = l.tid AND best.s1 = l.s1)
        SELECT band, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS true_rate FROM b WHERE band IS NOT NULL GROUP BY band""",
    "compare_shares": """WITH a AS (SELECT o_orderpriority AS bin, count(*) / sum(count(*)) OVER () AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
        b AS (SELECT o_orderpriority AS bin, count(*) / sum(count(*)) OVER () AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), j AS (SELECT bin, coalesce(t, 0) AS t, coalesce(a, 0) AS a FROM a FULL JOIN b USING (bin))
        SELECT bin, round(t, 9) AS true_share, round(a, 9) AS accepted_share, round(a - t, 9) AS excess, round(a / greatest(t, 1e-4), 9) AS factor FROM j""",
    "drop_rerank": f"""WITH {PRED}, d AS (SELECT * FROM pred WHERE s1 NOT IN (SELECT 'S1-' || s_suppkey FROM supplier WHERE s_acctbal < 0))
        SELECT tid, s1, round(p, 9) AS pf_score, row_number() OVER (PARTITION BY tid ORDER BY p DESC, s1)::INT AS pf_rank FROM d""",
    "top1_context": f"WITH {PRED}, c AS (SELECT s1, count(*) AS n FROM best GROUP BY s1) SELECT tid, s1, rank::INT AS pf_rank, coalesce(n, 0)::INT AS s1_top1_count FROM ranked LEFT JOIN c USING (s1)",
    "rescore": f"WITH {PRED} SELECT tid, s1, round(CASE WHEN p >= 0.3 THEN p * p ELSE p END, 9) AS p FROM pred",
    "open_targets": f"WITH {PRED} SELECT tid, round(max(p), 9) AS best_p, any_value(country) AS country FROM pred GROUP BY tid HAVING max(p) < 0.7",
    "dense_top_k": """WITH d AS (SELECT a.vec_id::VARCHAR AS tid, b.vec_id::VARCHAR AS s1, a.label::VARCHAR AS country, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY c DESC, s1) AS k FROM d)
        SELECT tid, s1, country, round(c, 6) AS dense_cos, k::INT AS dense_rank FROM r WHERE k <= 5""",
    "gate_report": """WITH d AS (SELECT a.vec_id AS tid, b.vec_id AS s1, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY c DESC, s1::VARCHAR) AS k FROM d),
        g AS (SELECT k, count(*) AS n, sum((abs(tid - s1) <= 20)::INT) AS t FROM r WHERE k <= 5 GROUP BY k)
        SELECT k::INT AS dense_rank, (sum(n) OVER o)::BIGINT AS pairs, (sum(t) OVER o)::BIGINT AS true, round((sum(t) OVER o) / greatest((SELECT sum(t) FROM g), 1), 9) AS kept FROM g WINDOW o AS (ORDER BY k)""",
    "id_lists": f"""WITH {PRED}, {PREFIX} SELECT r.s1 AS source1_entity_id, coalesce(string_agg(kept.tid, ',' ORDER BY kept.tid), '') AS matched_entity_ids FROM reference r LEFT JOIN kept USING (s1) GROUP BY r.s1""",
    "resolve_documents": f"""WITH {KEYS}, pred AS (SELECT tid, s1, country, least(round(cos, 6), 0.999::DOUBLE) AS p FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY round(cos, 8) DESC, s1) AS r FROM cos) WHERE r <= 10 AND tid <> s1),
        best AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY tid ORDER BY p DESC, s1) = 1), {PREFIX.replace("0.5", "0.3")} SELECT s1, string_agg(tid, ',' ORDER BY p DESC, tid) AS tids FROM kept GROUP BY s1""",
    "truth_links": f"WITH {PRED} SELECT tid, s1 FROM links WHERE s1 IN (SELECT s1 FROM reference)",
} | pair_queries.ORACLE_SQL
