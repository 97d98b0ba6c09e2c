import random
from itertools import combinations

import pytest
from recordloom.llm import common, similar


def reached(n, linked):
    """Of each of n nodes the least node that links reach."""
    at = list(range(n))
    for _ in range(n):
        before = list(at)
        for i, j in linked:
            at[i] = at[j] = min(at[i], at[j])
        if at == before:
            return at
    return at


def family(rng, n, words=60):
    """Texts with edits of a few bases, some of them between two bases, and some of few words."""
    bases = [[f"w{rng.randrange(5000)}" for _ in range(words)] for _ in range(3)]
    texts = []
    for i in range(n):
        w = list(bases[0 if i % 3 else i % 9 // 3])
        for at in rng.sample(range(words), rng.choice([0, 1, 1, 2, 3, 6])):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    small = [f"s{i}" for i in range(9)]
    return list(dict.fromkeys(texts + [" ".join(small[:k]) for k in (7, 8, 9)]))


@pytest.mark.parametrize("block, shard", [(1 << 10, 1 << 15), (12, 1 << 15), (5, 7)])
def test_groups_are_what_similar_sets_reach(spark, monkeypatch, block, shard):
    """All in one bucket: whatever a block and a tree hold, links join exactly what is similar; fingerprints in trees only leave out what isn't."""
    monkeypatch.setattr(similar.simhash, "SHARD", shard)
    monkeypatch.setattr(similar.candidates, "__defaults__", (similar.RADIUS, shard))
    texts = family(random.Random(11), 90)
    sets = [set(similar.shingle_hashes(t).tolist()) for t in texts]
    want = reached(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    rows = [(i, len(s), bytearray(similar.fingerprint(similar.shingle_hashes(t)))) for i, (t, s) in enumerate(zip(texts, sets, strict=True))]
    nodes = common.materialize(spark.createDataFrame(rows, "node long, n long, fp binary"))
    members = common.materialize(spark.createDataFrame([(7, i, len(texts)) for i in range(len(texts))], "key long, node long, n long"))
    got = {r.node: r.root for r in similar.groups(members, nodes, common.materialize(spark.createDataFrame(list(enumerate(texts)), "node long, text string")), block=block).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want and len(set(want)) < len(texts) - 20


def test_candidates_are_joined_by_fingerprints_in_trees(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(256) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(40, 80))) for f in fps for _ in range(4)]
    linked = [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= similar.RADIUS]
    want = reached(len(fps), linked)
    for shard in (1 << 15, 40):
        members = spark.createDataFrame([(1, i, 100, bytearray(f.to_bytes(32, "big")), len(fps)) for i, f in enumerate(fps)], "key long, node long, n_shingles long, fp binary, n long")
        edges = [(r.a, r.b) for r in similar.candidates(members, shard=shard).collect()]
        assert all(tuple(sorted(e)) in set(linked) for e in edges) and reached(len(fps), edges) == want


@pytest.mark.parametrize("rest", [0, 5, 1000])
def test_wide_tree_finds_each_component(monkeypatch, rest):
    monkeypatch.setattr(similar, "REST", rest)
    rng = random.Random(rest)
    tree, values, edges = similar.WideTree(20), [], []
    for _ in range(300):
        x = rng.choice(values) ^ sum(1 << b for b in rng.sample(range(64), 12)) if values and rng.random() < 0.7 else rng.getrandbits(64)
        if x not in values:
            edges += [(values.index(y), len(values)) for y in tree.insert(x)]
            values.append(x)
    want = reached(len(values), [(i, j) for i, j in combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 20])
    assert reached(len(values), edges) == want and tree.parts == len(set(want)) and len(edges) == len(values) - tree.parts
