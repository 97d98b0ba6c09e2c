import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from duck import rows as duck_rows
from duck import spark_rows
from pyspark.sql import functions as F

from recordloom.llm import common, mixing, quality_rules, queries, secret_scans, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == duck_rows(queries.ORACLE_SQL[name], sf)


# ---------------------------------------------------------------- quality rules


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_base(odd):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(odd).collect())
    want = Counter()
    for r in odd.collect():
        b = base_counts(r.text)
        want[r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0]] += 1
    assert got == want


@pytest.mark.parametrize("most", [quality_rules.BROADCAST_LINES, 0])
def test_frequent_lines_go(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", most)  # broadcast, or joined
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"Subscribe  NOW to us\n{body(i)}", "site") for i in range(40)] + [(100, "subscribe now to us\n" + "subscribe now to us " * 2 + "a b c d", "site"), (101, "Subscribe NOW to us\n" + body(101), "other")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(d, with_text=True).collect()}
    assert all(got[i].kept and got[i].cleaned == body(i) and got[i].n_removed_words == 4 for i in range(40))
    assert not got[100].kept  # 8 words left, of 16
    assert got[101].kept and got[101].n_removed_words == 0
    assert quality_rules.passing_documents(d.withColumn("kept", F.lit(1))).count() == 41


def test_joined_lines_give_the_same_rows_as_broadcast_ones(spark, sf, odd, monkeypatch):
    docs = [common.read(spark, sf, "documents"), odd]
    known = [Counter(map(tuple, quality_rules.judge(d, with_text=True).collect())) for d in docs]
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", 0)
    assert [Counter(map(tuple, quality_rules.judge(d, with_text=True).collect())) for d in docs] == known
    # the query's facts hold no texts, so none is exchanged however many lines are frequent
    assert "__text" not in quality_rules.facts(docs[0]).columns


# ---------------------------------------------------------------- secrets


def base_spans(x):
    out, n = [], [0, 0, 0]
    for m in re.finditer(secret_scans.ASSIGN, x):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
            n[0] += 1
    for k, p, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        for m in re.finditer(p, x):
            if len(m.group()) >= least:
                out.append((m.start(), k, m.end()))
                n[k] += 1
    return n, ",".join(f"{secret_scans.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_secrets(spark, sf, odd, which):
    docs = common.read(spark, sf, "documents") if which == "sf" else odd
    got = secret_scans.find_secrets(docs).collect()
    want = Counter()
    for r in docs.collect():
        n, s = base_spans(r.text or "")
        want[r.doc_id, *n, hashlib.sha256(s.encode()).hexdigest(), s] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, ",".join(x for x in r.spans.split(",") if "owned" not in x)) for r in got) == want


def test_ownership(spark):
    own, shared = "Zx81kQ92mmP04aaBcD77e", "Ab12Cd34Ef56Gh78Ij90K"
    rows = [(1, f"see {own} here \x01 x", "a", "en")] + [(10 + i, f"example {shared} é", f"s{i}", "en") for i in range(6)] + [(20 + i, f"token = {shared}", f"s{i}", "en") for i in range(6)]
    got = {r.doc_id: r for r in secret_scans.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got[1].spans == f"owned:4:{4 + len(own)}" and got[1].n_assign == 0
    assert all(got[10 + i].spans == "" and got[20 + i].n_examples == 1 and got[20 + i].spans.startswith("assign:0:") for i in range(6))
    d = secret_scans.without_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    texts = {r.doc_id: r.text for r in d.collect()}
    assert texts[1] == "see <SECRET> here \x01 x" and texts[10] == f"example {shared} é" and texts[20] == "<SECRET>"


def test_many_repositories_of_few_owners(spark):
    spread, hot = "Qw81kQ92mmP04aaBcD77e", "Hh12Cd34Ef56Gh78Ij90K"
    rows = [(i, f"see {spread} here", f"s{i % 2}", f"l{i}") for i in range(6)] + [(100 + i, f"my {hot} x", "s0", "en") for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in secret_scans.find_secrets(d).collect()}
    assert all(got[i].spans == "" and (got[i].most_owners, got[i].most_repos) == (2, 6) for i in range(6))
    assert all(got[100 + i].spans == f"owned:3:{3 + len(hot)}" and got[100 + i].most_repos == 1 for i in range(2000))


# ---------------------------------------------------------------- sharding


def check_shards(docs, rows, bound):
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1 if r.text is not None else 1, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    if bound:
        sizes = [sum(r["size"] for r in by[k]) for k in range(8)]
        assert max(sizes) < bound * sum(sizes) / 8
    return by


def test_sharding(spark, sf):
    docs = common.read(spark, sf, "documents")
    rows = sharding.shard_documents(docs).collect()
    check_shards(docs, rows, 1.15)
    by = {r.doc_id: r.shard for r in rows}
    shards = defaultdict(set)
    for r in docs.select("doc_id", "text").collect():
        shards[r.text].add(by[r.doc_id])
    assert max(map(len, shards.values())) == 1


def test_sharding_a_hot_text(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 16)).alias("text"))
    check_shards(docs, sharding.shard_documents(docs).collect(), 1.02)


def test_sharding_odd(odd, empty):
    check_shards(odd, sharding.shard_documents(odd).collect(), None)
    assert sharding.shard_documents(empty).count() == 0


def test_repeated_rows_are_split(spark):
    """A third of all bytes are one text of one id, and a third one text without any id."""
    rows = [(5, "again " * 20)] * 400 + [(None, "nameless " * 14)] * 400 + [(i, f"text {i} " * 18) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = Counter()
    for r in sharding.shard_documents(docs).collect():
        sizes[r.shard] += r["size"]
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) <= 1.05 * min(sizes.values())


# ---------------------------------------------------------------- mixing


def targets_by_hand(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, share = total - sum(3 * sizes[s] for s in capped), sum(w[s] for s in names if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else left * w[s] / share for s in names}
        over = {s for s in names if t[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("which", ["sf", "odd", "uneven"])
def test_mixing(spark, sf, odd, which):
    if which == "uneven":
        docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") < 3, "a").when(F.col("id") < 60, "b").when(F.col("id") < 70, None).otherwise("c").alias("source"))
    else:
        docs = common.read(spark, sf, "documents") if which == "sf" else odd
    rows = mixing.taken_words(mixing.keys_of(docs), block=16).collect()
    sizes = defaultdict(int)
    want = Counter()
    for r in docs.select("doc_id", "text", "source").collect():
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        want[r.doc_id, n] += 1
    assert Counter((r.doc_id, r["size"]) for r in rows) == want
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    t = targets_by_hand(sizes)
    by_target = defaultdict(int)
    for r in rows:
        by_target[r.source_size, round(r.target, 6)] += r.taken
    expected = defaultdict(float)
    for s, x in t.items():
        expected[sizes[s], round(x, 6)] += x
    assert set(by_target) == {k for k in expected}
    assert all(abs(by_target[k] - x) <= 0.02 * x + 16 * 3 for k, x in expected.items())


def test_mixed_texts(spark, sf):
    docs = common.read(spark, sf, "documents")
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixing.keys_of(docs)).collect()}
    rows = mixing.mixed_documents(docs).collect()
    words = Counter()
    texts = {r.doc_id: (r.text, Counter(WORD.findall(r.text))) for r in docs.collect()}
    for r in rows:
        w = WORD.findall(r.text)
        words[r.doc_id] += len(w)
        assert r.text == texts[r.doc_id][0] or all(part in texts[r.doc_id][0] for part in re.split("\n", r.text))
    assert words == Counter({d: n for d, n in taken.items() if n})


@pytest.mark.parametrize("n", [1, 2, 3, 64, 997, 20_000])
def test_permutations(spark, n):
    size = F.lit(n).cast("long")
    d = spark.range(n).withColumn("keys", mixing.round_keys(size, F.lit("s"), 42))
    rows = d.select(*[mixing.permuted(F.col("id"), size, F.col("keys"), F.lit(e).cast("long")).alias(f"e{e}") for e in range(3)]).collect()
    cols = [[r[f"e{e}"] for r in rows] for e in range(3)]
    assert all(sorted(c) == list(range(n)) for c in cols)
    if n >= 997:
        assert len({tuple(c) for c in cols}) == 3
        for c in cols:
            strides = Counter((b - a) % n for a, b in zip(c[:-1], c[1:], strict=True))
            assert strides.most_common(1)[0][1] <= 12 and len(strides) > 0.5 * n  # neighbours keep no stride
            thirds = Counter((3 * i // n, 3 * x // n) for i, x in enumerate(c))
            assert all(abs(k - n / 9) < 6 * (n / 9) ** 0.5 for k in thirds.values())


def test_counts_of_sources_over_shards(spark):
    """The drawn counts add up to each source's slots, spread as draws do, and the slots are laid out by them."""
    sizes = [("a", 640_000), ("b", 64_000), (None, 6400), ("d", 64)]
    keys = spark.createDataFrame([(s, n) for s, n in sizes], "source string, size long")
    sources = mixing.with_targets(keys).cache()
    slots = {r.source: r.n_slots for r in sources.collect()}
    counts = [r.asDict() for r in mixing.draw_counts(sources, shard_slots=500).collect()]
    rows = mixing.draw_slots(sources, shard_slots=500).collect()
    shards = -(-sum(slots.values()) // 500)
    by = Counter()
    for c in counts:
        by[c["source"]] += c["count"]
    assert by == Counter(slots)
    assert Counter((r.source, r.shard) for r in rows) == Counter({(c["source"], c["shard"]): c["count"] for c in counts})
    for s, n in slots.items():
        mine = sorted((r.slot, r.shard, r.epoch, r.block) for r in rows if r.source == s)
        assert [x[0] for x in mine] == list(range(n)) and [x[1] for x in mine] == sorted(x[1] for x in mine)
        blocks = Counter(x[3] for x in mine)
        assert max(blocks.values()) <= 3 and max(blocks.values()) - min(blocks.values()) <= 1 or len(blocks) < -(-dict(sizes)[s] // 64)
    big = [c["count"] for c in counts if c["source"] == "a"]
    mean = slots["a"] / shards
    chi2 = sum((x - mean) ** 2 / mean for x in big)
    assert len(big) == shards and 0.4 * shards < chi2 < 2 * shards  # neither equal shares nor clumps
    again = mixing.draw_slots(sources, shard_slots=500).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    other = mixing.draw_slots(sources, seed=7, shard_slots=500).collect()
    assert Counter(map(tuple, other)) != Counter(map(tuple, rows))


def test_nothing(empty):
    assert quality_rules.judge(empty).count() == 0
    assert secret_scans.find_secrets(empty).count() == 0
    assert mixing.taken_words(mixing.keys_of(empty)).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
