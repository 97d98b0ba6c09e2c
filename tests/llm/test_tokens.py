import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm import common, packing, token_counts, token_output, tokens

BYTE, WORD = (tokens.public_path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids(path, text):
    return tokens.tokenizer(path).encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def read(spark, sf):
    return common.read(spark, sf, "documents")


@given(st.text(st.sampled_from("aB'stl re1²ß é\n\t  .,!<|>—€ 日"), max_size=30))
@settings(max_examples=400, deadline=None)
def test_cached_ids_are_the_librarys(text):
    for path in (BYTE, WORD):
        assert tokens.ids_encoder(path).batch([text])[0] == np.array(ids(path, text), "<u4").tobytes()


def test_cache_stays_bounded():
    e = tokens.Encoder(BYTE, len, sum, {"the": 1}, limit=50)
    texts = [f"word{i} the thing{i}" for i in range(500)]
    assert e.batch(texts) == [len(ids(BYTE, t)) for t in texts] and len(e.cache) < 60 and len(e.old) < 60


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_counts(spark, sf, odd, which):
    docs = read(spark, sf) if which == "sf" else odd
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTE, table=50).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(ids(BYTE, r.text)), n > 1024) for r in docs.select("doc_id", "text").collect())
    assert got == want


def test_frequent_pretokens(spark, sf):
    docs = read(spark, sf)
    want = Counter(w for r in docs.select("text").collect() for w in tokens.pre_tokens(r.text, "byte") or [])
    got = token_counts.frequent_pretokens(docs, BYTE, table=20)
    assert got == [w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:20]]


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_files_round_trip(spark, sf, odd, which):
    docs = (read(spark, sf) if which == "sf" else odd).where("doc_id is not null")
    path = common.work_dir(spark)
    token_output.write_tokens(docs.repartition(3), path, BYTE)
    rows = token_output.read_tokens(spark, path)
    want = Counter((r.doc_id, tuple([*ids(BYTE, r.text), 2])) for r in docs.select("doc_id", "text").collect())
    got = sorted(rows.collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.tokens)) for r in got) == want
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.tokens)
        at += r.n_tokens
    assert {(r.start, r.ids_crc32) for r in token_output.digests(rows).collect()} == {(r.start, crc(r.tokens)) for r in got}


def test_files_have_page_indexes_and_row_groups(spark, sf, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    token_output.write_tokens(read(spark, sf), f"file://{path}", BYTE)
    f = next(p for p in sorted((tmp_path / "t").glob("*.parquet")) if pq.ParquetFile(p).metadata.num_row_groups)
    c = {pq.ParquetFile(f).metadata.row_group(0).column(i).path_in_schema: pq.ParquetFile(f).metadata.row_group(0).column(i) for i in range(5)}
    assert all(x.has_offset_index and x.has_column_index for x in c.values())
    assert "DELTA_BINARY_PACKED" in str(c["doc_id"].encodings) and "DICTIONARY" in str(c["tokens.list.element"].encodings)


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_packing(spark, sf, odd, which):
    docs = read(spark, sf) if which == "sf" else odd
    pieces = common.materialize(packing.tokenize_pieces(docs, WORD, with_ids=True, size=512))
    rows = packing.pack(pieces, 512).collect()
    want = Counter((r.doc_id, tuple([*ids(WORD, r.text), 2])) for r in docs.select("doc_id", "text").collect())
    cut = Counter()
    for (d, i), n in want.items():
        for s in range(0, len(i), 512):
            cut[d, s, i[s : s + 512], len(i)] += n
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in rows) == cut
    assert all(r.ids_crc32 == crc(r.ids) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 512
    assert sorted(by) == list(range(len(by)))
    assert len(by) <= sum(r.length for r in rows) / 512 * 1.1 + 1


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=200, deadline=None)
def test_histogram_packing(histogram):
    runs, n = packing.pack_histogram(histogram, 64)
    bins, ranks = {}, {}
    count = {}
    for i, (length, first, times, seq, off) in enumerate(runs):
        end = min([r[1] for r in runs if r[0] == length and r[1] > first] or [histogram[length]])
        for k in range(end - first):
            bins.setdefault(seq + k // times, []).append((off + k % times * length, length))
            ranks.setdefault(length, []).append(first + k)
            count[length] = count.get(length, 0) + 1
    assert count == histogram and len(bins) == n
    assert all(sorted(r) == list(range(histogram[x])) for x, r in ranks.items())
    for b in bins.values():
        at = 0
        for o, length in sorted(b):
            assert o == at
            at += length
        assert at <= 64


def test_one_length_for_all(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(100).cast("long").alias("length"))
    rows = packing.pack(common.materialize(d), 512).collect()
    assert len({r.sequence_id for r in rows}) == 600 and len({(r.sequence_id, r.offset) for r in rows}) == 3000


def test_empty(empty):
    assert token_counts.count_tokens(empty, BYTE).count() == 0
    assert packing.pack(common.materialize(packing.tokenize_pieces(empty, WORD))).count() == 0
    path = common.work_dir(empty.sparkSession)
    token_output.write_tokens(empty, path, BYTE)
    assert token_output.read_tokens(empty.sparkSession, path).count() == 0
