import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import text
from recordloom.operators import assignment, blocking, diagnostics, group_features, metrics, pair_features, rescue, splits, vectors

PRED = "tid string, s1 string, country string, p double"


def lists(d):
    return {r.s1: list(r.tids) for r in d.collect()}


@pytest.mark.parametrize("ps,miss,keep", [([0.9, 0.8], 0.4, 2), ([0.99, 0.3], 0.0, 1), ([0.4], 0.0, 0)])
def test_expected_prefix_goldens(spark, ps, miss, keep):
    rows = [(f"t{i}", "a", "X", p) for i, p in enumerate(ps)] + ([("m", "a", "X", miss / 2), ("n", "a", "X", miss / 2)] if miss else [])
    got = lists(assignment.assign(spark.createDataFrame(rows, PRED), 0.25))
    assert len(got.get("a", [])) == keep


def test_expected_prefix_is_the_best_of_all(spark):
    rng, rows = random.Random(5), []
    for s in range(40):
        rows += [(f"t{s}-{i}", f"s{s}", "X", round(rng.random(), 3)) for i in range(rng.randint(1, 6))]
    got = lists(assignment.assign(spark.createDataFrame(rows, PRED), 0.3))
    for s in range(40):
        mine = sorted(((t, p) for t, a, _, p in rows if a == f"s{s}"), key=lambda x: (-x[1], x[0]))
        acc, total = [x for x in mine if x[1] >= 0.3], sum(p for _, p in mine)
        scores = [math.prod(1 - p for _, p in acc) * math.exp(-(total - sum(p for _, p in acc)))]
        scores += [1.25 * sum(p for _, p in acc[:k]) / (0.25 * total + k) for k in range(1, len(acc) + 1)]
        k = scores.index(max(scores))
        assert got.get(f"s{s}", []) == [t for t, _ in acc[:k]]


def test_a_target_goes_to_one_record_and_ties_to_the_smaller(spark):
    d = spark.createDataFrame([("t", "b", "X", 0.9), ("t", "a", "X", 0.9), ("u", "b", "X", 0.2)], PRED)
    assert lists(assignment.assign(d, 0.5, False)) == {"a": ["t"]}
    assert lists(assignment.assign(d, 0.99)) == {}


def test_thresholds_by_country(spark):
    d = spark.createDataFrame([("t", "a", "US", 0.5), ("u", "b", "FR", 0.5), ("v", "c", "ES", 0.95)], PRED)
    th = assignment.country_thresholds(d, 0.4, spark.createDataFrame([("US",)], "country string"), {"ES": 0.9})
    assert {r.country: r.threshold for r in th.collect()} == {"US": 0.4, "FR": 0.6, "ES": 0.9}
    assert lists(assignment.assign_by_country(d, th)) == {"a": ["t"], "c": ["v"]}


def test_metric(spark):
    s = "s1 string, tids array<string>"
    truth = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", []), ("d", ["z"])], s)
    pred = spark.createDataFrame([("a", ["x", "y", "w"]), ("b", ["q"])], s)
    f = {r.s1: r.f for r in metrics.entity_scores(truth, pred).collect()}
    assert round(f["a"], 3) == 0.714 and f["b"] == 0 and f["c"] == 1 and f["d"] == 0
    m = metrics.evaluate(truth, pred, truth).first()
    assert (m.entities, m.singletons, m.singleton_accuracy, m.candidate_recall_ceiling) == (4, 2, 0.5, 1.0)


def test_tune(spark):
    truth = spark.createDataFrame([("a", ["t"]), ("b", [])], "s1 string, tids array<string>")
    rule, grid = metrics.tune(spark.createDataFrame([("t", "a", "X", 0.65), ("u", "b", "X", 0.45)], PRED), truth)
    assert rule == {"threshold": 0.5, "expected_f": False} and len(grid) == 16


def records(spark, n=30):
    rng = random.Random(3)
    base = [(f"{rng.choice(['blue', 'red', 'green'])} {rng.choice('harbor castle valley meadow'.split())} {rng.choice('foods motors books'.split())} {chr(97 + i)}{chr(98 + i % 20)}o", f"{i + 1} {rng.choice('maple cedar birch'.split())} street {rng.choice('springfield riverton'.split())}") for i in range(n)]
    s = "entity_id string, business_name string, business_address string, country string"
    ref = [(f"S1-{i}", a.title(), b, "US" if i % 2 else "India") for i, (a, b) in enumerate(base)]
    tgt = [(f"S{2 + i % 2}-{i}-{k}", a + (" ltd" if k else " pvt"), b.replace("street", "st") if k else b, "US" if i % 2 else "India") for i, (a, b) in enumerate(base) for k in range(2)]
    links = spark.createDataFrame([(t[0], f"S1-{t[0].split('-')[1]}") for t in tgt], "tid string, s1 string")
    return spark.createDataFrame(ref, s), spark.createDataFrame(tgt, s), links


def brute_channel(ref, tgt, keys, max_df):
    """Cosines of one channel by plain Python."""
    out = {}
    for c in {r["country"] for r in ref}:
        rk = {r["entity_id"]: keys(r) for r in ref if r["country"] == c}
        df = {}
        for ks in rk.values():
            for k in set(ks):
                df[k] = df.get(k, 0) + 1
        idf = {k: math.log((1 + len(rk)) / (1 + n)) + 1 for k, n in df.items() if n <= max_df(len(rk))}

        def unit(ks, idf=idf):
            w = {k: ks.count(k) * idf[k] for k in set(ks) if k in idf}
            norm = math.sqrt(sum(v * v for v in w.values())) or 1
            return {k: v / norm for k, v in w.items()}

        ru = {i: unit(ks) for i, ks in rk.items()}
        for t in tgt:
            if t["country"] == c:
                tu = unit(keys(t))
                cos = {i: sum(v * u.get(k, 0) for k, v in tu.items()) for i, u in ru.items()}
                top = sorted(((x, i) for i, x in cos.items() if x > 0.05), key=lambda y: (-round(y[0], 9), y[1]))[:10]
                out |= {(t["entity_id"], i): x for x, i in top}
    return out


def test_channels_against_brute_force(spark):
    a, b, _ = records(spark, 12)
    ref, tgt = text.normalize_records(a), text.normalize_records(b)
    got = {(r.tid, r.s1): r for r in blocking.retrieve(ref, tgt).collect()}
    ref, tgt = [r.asDict() for r in ref.collect()], [r.asDict() for r in tgt.collect()]

    def name_keys(r):
        w = r["name"].split()
        return [x for x in w if len(x) >= 2] + [f"{x}_{y}" for x, y in itertools.pairwise(w)] + (["P:" + r["compact"][:6]] if len(r["compact"]) >= 6 else [])

    def addr_keys(r):
        w = [x for x in r["addr"].split() if len(x) >= 3]
        return [f"{n}:{x}" for n in r["nums"].split()[:3] for x in w[:4]] + [f"{x}_{y}" for x, y in itertools.pairwise(w)]

    def sound_keys(r):
        w = r["skel"].split()
        return ["F:" + r["skel"].replace(" ", "")] + [x for x in w if len(x) >= 2] + [f"{x}_{y}" for x, y in itertools.pairwise(w)]

    def mixed_keys(r):
        s = [x for x in r["skel"].split() if len(x) >= 2][:3]
        w = [x for x in r["addr"].split() if len(x) >= 3][:8]
        return [f"{x}|{y}" for x in s for y in w] + [f"{x}#{y}" for x in s for y in r["nums"].split()[:4]]

    for ch, keys in (("name_key", name_keys), ("addr_key", addr_keys), ("phon_key", sound_keys), ("mix_key", mixed_keys)):
        want = brute_channel(ref, tgt, keys, lambda n: 200)
        assert {k for k, r in got.items() if r[ch] > 0} == set(want), ch
        assert all(abs(got[k][ch] - v) < 1e-9 for k, v in want.items()), ch


def test_grams(spark):
    g = spark.createDataFrame([("abc",), ("",)], "x string").select(blocking.grams(F.col("x")).alias("g")).collect()
    assert g[0].g == [" abc", "abc "]


def test_pair_features_and_recall(spark):
    a, b, links = records(spark, 12)
    ref, tgt = text.normalize_records(a), text.normalize_records(b)
    pairs = blocking.cheap_similarities(blocking.retrieve(ref, tgt), ref, tgt)
    rule = {"coef": [1.0] * 7, "intercept": 0.0, "features": list(blocking.PREFILTER_FEATURES)}
    top = blocking.rank_candidates(pairs, rule, 3)
    d = pair_features.pair_features(pair_features.with_context(top), ref, tgt)
    assert d.columns == ["tid", "s1", "t_country", *pair_features.FEATURES] and len(pair_features.FEATURES) == 41
    rows = d.collect()
    assert len({(r.tid, r.s1) for r in rows}) == len(rows) and max(r.pf_rank for r in rows) <= 3
    true = [r for r in rows if r.s1 == f"S1-{r.tid.split('-')[1]}"]
    assert len(true) == 24 and all(r.num_first_eq == 1 and r.is_s3 == int(r.tid.startswith("S3")) for r in true)
    rec = {r.channel: r.recall for r in blocking.channel_recall(pairs, links).collect()}
    assert rec["union"] == 1.0 and set(rec) == {*blocking.CHANNELS, "union"}


def test_group_features_without_siblings(spark):
    a, b, _ = records(spark, 4)
    ref, tgt = text.normalize_records(a), text.normalize_records(b)
    pred = spark.createDataFrame([("S2-0-0", "S1-0", "India", 0.3), ("S2-0-0", "S1-2", "India", 0.005)], PRED)
    rows = group_features.group_features(pred, ref, tgt).collect()
    assert len(rows) == 1 and rows[0].sib_k == 0 and rows[0].sib_addr_max is None
    pred = spark.createDataFrame([("S2-0-0", "S1-0", "India", 0.9), ("S2-0-1", "S1-0", "India", 0.8)], PRED)
    rows = {r.tid: r for r in group_features.group_features(pred, ref, tgt).collect()}
    assert rows["S2-0-0"].sib_k == 1 and rows["S2-0-0"].g_n_ex == 1 and rows["S2-0-1"].g_n9_ex == 1


def test_splits(spark):
    d = spark.range(2000).select(F.concat(F.lit("S1-"), "id").alias("s1"), F.col("id").alias("x"))
    dropped = splits.dropped_records(d)
    n = dropped.count()
    assert 300 < n < 460 and dropped.count() == n
    links = d.select(F.concat(F.lit("t"), "x").alias("tid"), "s1")
    held, touched, pool = splits.validation_split(links, links, d, dropped)
    assert held.join(dropped, "s1").count() == 0 and pool.join(touched, "tid").count() == 0 and pool.count() + touched.count() == 2000
    assert splits.sample_rows(d, 5, "s1").count() == 5
    assert {r["count"] for r in splits.sample_rows(d.withColumn("g", F.col("x") % 3), 4, "s1", by=("g",)).groupBy("g").count().collect()} == {4}


def test_dense_and_rescue(spark):
    a, b, links = records(spark, 6)
    ref, tgt = text.normalize_records(a), text.normalize_records(b)
    vec = lambda d: d.select("entity_id", "country", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.split("entity_id", "-")[1].cast("double") * i)).alias("embedding"))
    near = vectors.dense_top_k(vec(tgt), vec(ref), 2)
    assert all(r.dense_rank in (1, 2) for r in near.collect()) and near.count() == 24
    pred = spark.createDataFrame([("S2-0-0", "S1-2", "India", 0.2), ("S3-1-0", "S1-1", "US", 0.95)], PRED)
    r = rescue.rescue_candidates(pred, pred, vec(tgt), vec(ref), tgt, ref, 2)
    rows = r.collect()
    assert rows and {x.tid for x in rows} == {"S2-0-0"} and all(x.s1 != "S1-2" for x in rows)
    f = rescue.rescue_features(r, r.select("tid", "s1", F.lit(0.5).alias("ce")))
    assert set(rescue.RESCUE_FEATURES) <= set(f.columns)
    merged = rescue.merge_rescue(pred, f.withColumn("p", F.lit(0.9)), ("India",))
    assert merged.count() == 2


def test_diagnostics(spark):
    a, b, links = records(spark, 6)
    ref, tgt = text.normalize_records(a), text.normalize_records(b)
    pred = links.withColumns({"country": F.lit("US"), "p": F.lit(0.95)})
    m = assignment.assign(pred, 0.5)
    truth = links.groupBy("s1").agg(F.collect_list("tid").alias("tids"))
    ceilings = {r.change: r.macro_f05 for r in diagnostics.oracle_ceilings(truth, m, pred).collect()}
    assert ceilings["4 perfect"] == 1.0 and ceilings["2 all true candidates"] == 1.0
    bins = diagnostics.relation_bins(links, ref, tgt)
    assert {r.bin.split()[2] for r in bins.collect()} == {"#same"}
    flags = diagnostics.swap_flags(links, ref, tgt).join(pred.select("tid", "p", "country"), "tid")
    assert diagnostics.swap_rates(flags).first().swap_rate == 0.0
    wrong = spark.createDataFrame([("S2-0-0", "S1-3", "US", 0.05)], PRED)
    assert diagnostics.loosened(m, wrong, ref, tgt, 0.0, "US").count() >= m.count()
    assert diagnostics.tightened(m, pred, 0.99, "US", ref).count() <= m.count()
    assert diagnostics.neighbourhood(spark.createDataFrame([("S1-0",)], "s1 string"), links, pred, ref, tgt).count() >= 2
    assert [r.x for r in spark.createDataFrame([("Zürich",), ("विजय",)], "n string").select(diagnostics.native_script(F.col("n")).alias("x")).collect()] == [False, True]
