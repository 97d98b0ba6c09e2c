import random
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F
from recordloom.llm import common, similar


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def expected(rows):
    """Smallest id of each group, by all pairs."""
    sets, parent = sets_of([t for _, t in rows]), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted(map(min, groups.values()))


def test_stage_finds_near_copies(spark, sf):
    docs = common.read(spark, sf, "documents")
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in got.collect()) == expected([(r.doc_id, r.text) for r in docs.collect()]) and got.columns == docs.columns


def test_family_around_a_base(spark):
    """Copies with edits of their own are similar to the base, many not to each other."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(300), rng.randrange(2, 12)) if i else []:
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(80))) for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \n")]
    got = similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, F.col("doc_id")))
    assert sorted(r.doc_id for r in got.collect()) == expected(rows)


def test_blocks_of_sets_give_the_same_pairs(spark):
    """However few shingles a task may hold, every pair meets both its sets."""
    rng = random.Random(5)
    base = list(range(100))
    sets = [(i, sorted(rng.sample(base, rng.randrange(1, 100)))) for i in range(40)]
    d = common.materialize(spark.createDataFrame(sets, "node long, shingles array<long>"))
    every = [(i, j) for i, j in combinations(range(40), 2) if rng.random() < 0.5]
    pairs = common.materialize(spark.createDataFrame(every, "a long, b long"))
    of = {i: set(s) for i, s in sets}
    want = {(i, j) for i, j in every if len(of[i] & of[j]) >= 0.5 * len(of[i] | of[j])}
    for held in (1 << 20, 300, 40):
        got = [(r.a, r.b) for r in similar.similar(pairs, d, 0.5, held).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
