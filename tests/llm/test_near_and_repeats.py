import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm import common, components, nearest, simhash, suffix_dedup

# ---------------------------------------------------------------- SimHash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(fps, radius=3):
    """Component numbers of integers by brute force."""
    u, inv = np.unique(np.array(fps, "u8"), return_inverse=True)
    parent = list(range(len(u)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.nonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= radius)[0]:
            parent[root(i + 1 + int(j))] = root(i)
    return [root(int(i)) for i in inv]


def near_copies(spark, n=400):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocab) for _ in range(300)] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(base[i % 12 if i % 3 else 0])
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("which", ["sf", "odd", "copies"])
def test_simhash(spark, sf, odd, which):
    docs = {"sf": lambda: common.read(spark, sf, "documents"), "odd": lambda: odd, "copies": lambda: near_copies(spark)}[which]()
    rows = simhash.near_duplicates(docs).collect()
    want = Counter((r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in rows) == want
    label = groups([r.fp & (1 << 64) - 1 for r in rows])
    least = {}
    for g, r in zip(label, rows, strict=True):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(g) for g, r in zip(label, rows, strict=True))
    assert len({(g, r.group) for g, r in zip(label, rows, strict=True)}) == len(set(label))
    if which == "copies":
        assert len(set(label)) < 100
    kept = simhash.one_of_each(docs)
    assert kept.count() == len(set(label)) and kept.columns == docs.columns


@given(st.lists(st.integers(0, 255).map(lambda x: x * 0x0101010101010101 & (1 << 64) - 1) | st.integers(0, 1023), max_size=60), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_tree_links_connect_what_is_near(values, radius):
    values = list(dict.fromkeys(values))
    tree, edges = simhash.BKTree(radius), []
    for v in values[::2]:
        edges += [(v, y) for y in tree.insert(v)]
    for v in values[1::2]:
        near = tree.touch(v)
        assert bool(near) == any((v ^ y).bit_count() <= radius for y in values[::2])
        edges += [(v, y) for y in near]
    assert all((a ^ b).bit_count() <= radius for a, b in edges) and len(edges) <= 2 * len(values)


@pytest.mark.parametrize("refinements", [0, 1, 2])
def test_many_trees_for_one_shard(spark, refinements):
    rng = random.Random(2)
    fps = sorted({sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(600)})
    nodes = common.materialize(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long"))
    edges = simhash.links(nodes, shard=50, refinements=refinements)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in edges.collect())
    root = {r.node & (1 << 64) - 1: r.root for r in components.components(edges).collect()}
    label = groups(fps)
    got = [root.get(x, f"alone{x}") for x in fps]
    assert len(set(zip(label, got, strict=True))) == len(set(label)) == len(set(got))


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_shard_keys_meet(spark, blocks):
    rng = random.Random(blocks)
    pairs = []
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), 3))
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    d = spark.createDataFrame(pairs, "a long, b long")
    masks = simhash.shard_masks(blocks)
    assert d.where(F.arrays_overlap(simhash.shard_keys(F.col("a"), masks), simhash.shard_keys(F.col("b"), masks))).count() == 200
    # whichever shard a pair shares, it shares one of its finer shards too
    finer = simhash.refined_masks(masks)
    for k, mask in enumerate(masks):
        for x, y in pairs:
            if not (x ^ y) & mask:
                assert any(not (x ^ y) & m for m in finer[4 * k : 4 * k + 4])


def test_spread_join_is_the_join(spark):
    rows = common.materialize(spark.createDataFrame([("hot" if i % 3 else f"k{i % 40}", i) for i in range(6000)], "k string, v long"))
    counted = common.materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    table = counted.select("k", F.concat("k", F.lit("!")).alias("w")).where("k <> 'k3'")
    assert {r.k for r in common.hot_keys(counted, ["k"]).collect()} == {"hot"}
    for how in ("inner", "left"):
        assert Counter(map(tuple, common.spread_join(rows, table, ["k"], counted, how=how).collect())) == Counter(map(tuple, rows.join(table, "k", how).collect()))
    # as many hot keys as can be: the bound does not depend on the rows
    many = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") < 5000, 10**9).otherwise(1).alias("n"))
    hot = common.hot_keys(many, ["k"])
    assert hot.count() <= common.HOT_SHARE or hot.agg(F.sum("__salts")).first()[0] <= 2 * common.HOT_SHARE


def test_a_hub(spark):
    edges = spark.createDataFrame([(5, i) for i in range(100, 1500)] + [(i, 9000 + i) for i in range(100, 1500, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert set(got.values()) == {5} and len(got) == 1 + 1400 + 200


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


# ---------------------------------------------------------------- nearest


def exact(rows, q, k=10):
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f8")
    out = []
    for i, v in q:
        d = np.sqrt(((m - np.array(v)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out += [(i, r + 1, int(ids[j]), round(float(d[j]), 9)) for r, j in enumerate(order)]
    return out


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((8, 48))
    rows = [(i, [float(x) for x in np.float32(centers[i % 8] + 0.4 * rng.standard_normal(48))]) for i in range(3000)]
    rows += [(3000 + i, [1.0] * 48) for i in range(60)]  # equal vectors: ties go to the smaller id
    d = nearest.taking_part(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7))
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest.nearest(d, d.where("vec_id % 100 = 0")).collect()]
    want = exact(rows, [r for r in rows if r[0] % 100 == 0])
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.99 * len(want)
    assert [g for g in sorted(got) if g[0] == 3000] == [w for w in want if w[0] == 3000]
    blocks = nearest.nearest(d, d.where("vec_id % 100 = 0"), block=7).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in blocks} == {g[:3] for g in got}


def test_who_takes_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (None, [1.0, 2.0])]
    d = nearest.taking_part(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")))
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest.nearest(d, d.where("vec_id % 100 = 0")).collect()]
    assert sorted(got) == [(0, 1, 8), (0, 2, 8), (0, 3, 100), (100, 1, 8), (100, 2, 8), (100, 3, 0)]
    assert nearest.nearest(d.where("false"), d.where("false")).count() == 0


# ---------------------------------------------------------------- repeated strings


def by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if n[b[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype("i1")))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def words_by_hand(texts, passage):
    """Words in windows that another row has too."""
    words = [re.findall(common.WORD, t or "") for t in texts]
    rows = {}
    for i, w in enumerate(words):
        for p in range(len(w) - passage + 1):
            rows.setdefault(tuple(w[p : p + passage]), set()).add(i)
    out = []
    for w in words:
        shared = set()
        for p in range(len(w) - passage + 1):
            if len(rows[tuple(w[p : p + passage])]) > 1:
                shared.update(range(p, p + passage))
        out.append(len(shared))
    return out


def check(spark, texts, length=400, passage=51):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, length=length, passage=passage).collect()}
    assert got == dict(enumerate((*h, w) for h, w in zip(by_hand(texts, length), words_by_hand(texts, passage), strict=True)))


def test_passages_of_words(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FLUSH", 50)  # many flushes a task
    d = suffix_dedup.WORD_COVER
    assert {(a - b) % suffix_dedup.WORD_V for a in d for b in d} == set(range(suffix_dedup.WORD_V))
    rng = random.Random(8)
    text = lambda n: [rng.choice(["a", "bc", "def", "ghij", "klmno", "é", "12"]) for _ in range(n)]
    p = [text(n) for n in (50, 51, 52, 60, 120)]
    texts = [" ".join(text(rng.randrange(120)) + p[i % 5] + text(rng.randrange(90))) for i in range(30)]
    texts += [" ".join(p[1]), "\t\n ".join(p[3]), " ".join(p[4] * 3), " ".join(["the"] * 70), " ".join(["the"] * 90), " ".join(text(60) * 2), " ".join(["solo"] * 200), None, "", " " * 300]
    texts += [" ".join(p[2] + text(30))] * 3 + [" ".join(text(80))] * 2 + ["x" * 500 + " " + " ".join(p[1])]
    check(spark, texts)
    check(spark, texts, passage=31)


def test_passages_under_the_length(spark, sf):
    """Passages of over 50 words and under 400 bytes in otherwise unlike documents: each is caught, and no other document."""
    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").dropna()
    before = {r.doc_id: r.n_passage_words for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_passage_words").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    planted = rng.sample(sorted(i for i, n in before.items() if not n), 20)
    for k in range(0, 20, 2):
        passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(51 + k // 2))
        assert len(passage) < 400
        for i in planted[k : k + 2]:
            w = rows[i].split(" ")
            at = rng.randrange(len(w) + 1)
            rows[i] = " ".join([*w[:at], passage, *w[at:]])
    after = {r.doc_id: r.n_passage_words for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).select("doc_id", "n_passage_words").collect()}
    assert all(after[i] >= 51 for i in planted)
    assert {i for i, n in after.items() if n} - set(planted) == {i for i, n in before.items() if n}


def test_cover():
    d = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.V for a in d for b in d} == set(range(suffix_dedup.V))


def test_planted_repeats(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p = [text(n) for n in (399, 400, 401, 450, 700, 1500)]
    texts = [text(rng.randrange(900)) + p[i % 6] + text(rng.randrange(700)) for i in range(40)]
    texts += [p[5], p[5], p[4] + p[4], "a" * 1000, "ab" * 600, "x" * 399, "x" * 399, None, "", "é" * 300, "z" + "é" * 300]
    texts += [p[5][:k] + "#" + p[5][k + 1 :] for k in (100, 410, 700, 1000)]  # near copies
    check(spark, texts)


def test_edges_of_repeats(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    base = text(2000)
    texts = [text(rng.randrange(50)) + base[s : s + n] + text(rng.randrange(50)) for s in range(0, 1200, 97) for n in (395, 400, 405, 431, 432, 433)]
    check(spark, texts)


def test_shorter_length_and_odd_rows(spark, odd, empty):
    check(spark, ["ab" * 300, "q" * 350, "q" * 320 + "r" * 320, "r" * 305 + "s"], 305)
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(odd).collect())
    rows = odd.select("doc_id", "text").collect()
    texts = [r.text for r in rows]
    assert got == Counter((r.doc_id, *h, w) for r, h, w in zip(rows, by_hand(texts, 400), words_by_hand(texts, 51), strict=True))
    assert suffix_dedup.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(odd, length=300)


def test_very_long_text(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghij") for _ in range(300_000))
    check(spark, [long, long[131_000:132_500], long[262_000:262_399]])
