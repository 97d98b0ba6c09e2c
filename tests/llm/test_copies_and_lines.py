import random

import corpus_pipeline
from recordloom.llm import common, quality_rules


def test_copies_do_not_make_their_own_lines_frequent(spark, sf):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(15))
    copied = line() + "\n" + line()
    texts = [copied] * 120 + [line() + "\n" + line() for _ in range(380)]
    texts = [t + "\nall rights reserved here" if 120 <= i < 250 else t for i, t in enumerate(texts)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, common.read(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").schema)
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    assert len(got) == 500 and got[0] == copied
    assert not any("rights" in t for t in got.values())  # a line of many texts still goes
    assert sum(r.kept for r in quality_rules.judge(docs).collect()) == 380  # the query counts rows, as its SQL does
