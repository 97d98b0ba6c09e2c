import random

import numpy as np
import pyarrow as pa
from recordloom.llm import suffix_dedup


class Kept:
    def __init__(self):
        self.rows = []

    def add(self, h, g, f, doc, pos):
        self.rows += [(int(x), int(p)) for x, p in zip(f, pos, strict=True)]


def kinds(uid, text):
    batch = pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([text]), pa.array([[20]])], ["uid", "text", "at"])
    sender = Kept()
    list(suffix_dedup._blocks(400)()(batch, sender))
    edges = [f for f, p in sender.rows if p // 2 < suffix_dedup.STEP - 1]  # blocks that begin before the text
    assert edges
    return set(edges)


def test_texts_of_far_partitions_have_kinds_of_their_own():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    seen = [kinds((p << 33) + row, text) for p in (0, 1, 127, 128, 129, 256, 1 << 20) for row in (0, 5)]
    assert len(set().union(*seen)) == sum(map(len, seen))


def test_no_suffix_before_or_beyond_a_text(spark):
    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(600))
    rows = [(1, 1, text, [2], [190, 10**6]), (2, 2, text, [], [-30])]
    got = suffix_dedup.cut(spark.createDataFrame(rows, "k1 long, k2 long, text string, blocks array<long>, starts array<long>")).collect()
    assert [(r.k1, r.n_removed, [tuple(x) for x in r.spans], bytes(r.kept)) for r in got] == [(1, 590, [(0, 590)], text[590:].encode())]
    assert np.min(suffix_dedup.suffixes_of([2], 400)) < 0
