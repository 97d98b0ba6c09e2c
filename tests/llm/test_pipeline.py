import gc
import re
import threading
import time
from collections import Counter

import corpus_pipeline
from recordloom import session
from recordloom.llm import common, mixing, packing, quality_rules, queries, secret_scans, similar, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf):
    docs = common.read(spark, sf, "documents")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert len(stages) == 5

    judged = {r.doc_id: r for r in quality_rules.judge(docs, distinct_texts=True, with_text=True).collect()}
    a = common.materialize(stages[0](spark, docs, sf))
    assert a.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in a.collect()} == {d: (r.cleaned, len(r.cleaned)) for d, r in judged.items() if r.kept}

    # by brute force: sets of five-word shingles, every pair, what links reach
    texts = {r.doc_id: set(similar.shingle_hashes(r.text)) for r in a.collect()}
    group = {d: d for d in texts}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(texts)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            if len(texts[x] & texts[y]) >= 0.8 * len(texts[x] | texts[y]):
                lo, hi = sorted((root(x), root(y)))
                group[hi] = lo
    b = common.materialize(stages[1](spark, a, sf))
    assert sorted(r.doc_id for r in b.collect()) == sorted(d for d in ids if root(d) == d) and b.columns == docs.columns

    spans = {r.doc_id: r.spans for r in secret_scans.find_secrets(b).collect()}
    c = common.materialize(stages[2](spark, b, sf))
    before = {r.doc_id: r.text for r in b.collect()}
    for r in c.collect():
        t, at, out = before[r.doc_id], 0, ""
        for s, e in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans[r.doc_id].split(",") if x):
            if s >= at:
                out += t[at:s] + "<SECRET>"
            at = max(at, e)
        assert r.text == out + t[at:] and r.n_chars == len(r.text)

    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixing.keys_of(c)).collect()}
    d = common.materialize(stages[3](spark, c, sf))
    words = Counter()
    for r in d.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == Counter({k: n for k, n in taken.items() if n}) and d.columns == docs.columns

    e = stages[4](spark, d, sf).collect()
    want = Counter()
    for r in d.collect():
        n = len(tokens.tokenizer(tokens.public_path("word_bpe_49k.json")).encode(r.text, add_special_tokens=False).ids) + 1
        for s in range(0, n, packing.SIZE):
            want[r.doc_id, s, min(packing.SIZE, n - s)] += 1
    assert Counter((r.doc_id, r.start, r.length) for r in e) == want


def pieces(rows):
    return Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows.collect())


def test_runs_do_not_touch_each_other(spark, sf):
    """The first of two runs is read after the second, and both are the stages one after the other."""
    docs = common.read(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf))
    want = pieces(docs)
    first, second = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    assert pieces(first) == want and pieces(second) == want and sum(want.values()) > 100


def test_runs_at_once(spark, sf):
    found = {}

    def work(k):
        found[k] = pieces(corpus_pipeline.run(spark, sf))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found[0] == found[1]


def test_no_folder_is_left(spark, sf):
    def unused():
        for _ in range(20):
            gc.collect()
            spark._jvm.System.gc()
            session.sweep(spark)
            if made and not any(p in session._used for p in made):
                break
            time.sleep(0.2)
        left = []
        for p in made:
            fs, path = session._folder(spark, p)
            left += [p] * fs.exists(path)
        return left

    for run in (lambda: corpus_pipeline.run(spark, sf), lambda: queries.QUERIES["op3_simhash"](spark, sf), lambda: queries.QUERIES["op9_token_files"](spark, sf), lambda: queries.QUERIES["op4_suffix_dedup"](spark, sf)):
        with session.watched() as made:
            assert run().count() > 0
        assert unused() == []


def test_odd_rows_and_none(spark, odd, empty, sf):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialize(stage(spark, docs, sf))
            if name != "packing":
                assert docs.columns == odd.columns
