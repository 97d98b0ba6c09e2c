"""Cases of review findings: queries against their SQL on tables made for them."""

import random

import duckdb
import pytest
from duck import rows, spark_rows

from recordloom import queries
from recordloom.functions import similarity
from recordloom.operators import blocking, name_pairs


def test_rank_top8_orders_by_all_digits(spark, tmp_path):
    """Orders of sf0.1 with scores that differ after the ninth digit."""
    for t in ("orders", "lineitem", "customer", "nation", "supplier"):
        where = {"orders": "WHERE o_orderkey IN (129583, 83265, 97491, 18619, 2192)", "lineitem": "WHERE l_orderkey IN (129583, 83265, 97491, 18619, 2192)"}.get(t, "")
        duckdb.sql(f"COPY (SELECT * FROM read_parquet('/root/testdata/sf0.1/{t}.parquet') {where}) TO '{tmp_path}/{t}.parquet'")
    assert spark_rows(queries.QUERIES["rank_top8"](spark, str(tmp_path))) == rows(queries.ORACLE_SQL["rank_top8"], str(tmp_path))


def test_jaro_winkler_table_is_the_kernel():
    rng = random.Random(1)
    a, b = (["".join(rng.choice("abcé😀 d") for _ in range(rng.choice([0, 1, 3, 5, 8, 18, 33, 64, 65]))) for _ in range(60)] for _ in range(2))
    table = similarity.jaro_winkler_table(a, b, 6)
    assert all(table[i, j] == similarity.rounded(similarity.jaro_winkler(a[i], b[j]), 6) for i in range(60) for j in range(60))


def test_jaro_winkler_makes_no_row_of_a_pair_before_its_result(spark, sf):
    assert "ArrowEvalPython" not in queries.QUERIES["jaro_winkler"](spark, sf)._jdf.queryExecution().toString()


def test_name_pairs_of_blocks(spark, monkeypatch):
    """Nulls, repeated rows, and a name that fills a block: every pair of a group, once for each pair of rows."""
    monkeypatch.setattr(name_pairs, "BLOCK", 4)
    rng = random.Random(2)
    left, right = ([(rng.choice([1, 1, 2, None]), rng.choice([None, *range(30)]), rng.choice([None, "x", "x", "x", "martha", "marhta", f"n{i}"])) for i in range(60)] for _ in range(2))
    want = sorted((repr((a, b, None if x is None or y is None else similarity.rounded(similarity.jaro_winkler(x, y), 6))) for g, a, x in left for h, b, y in right if g == h and g))
    d = lambda rows: spark.createDataFrame(rows, "group int, key long, name string")
    assert sorted(repr(tuple(r)) for r in name_pairs.jaro_winkler_pairs(d(left), d(right), 6).collect()) == want


def tables(tmp_path, docs):
    duckdb.sql("CREATE OR REPLACE TABLE made (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    duckdb.executemany("INSERT INTO made VALUES (?, ?, ?, 's', 1)", docs)
    duckdb.sql(f"COPY made TO '{tmp_path}/documents.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["block_name_key", "resolve_documents"])
def test_blocking_in_blocks_gives_the_rows_of_its_sql(spark, tmp_path, monkeypatch, name):
    """Many passes, blocks and parts; repeated ids, also in two languages, empty texts, more than ten near copies."""
    monkeypatch.setattr(blocking, "KEYS_AT_ONCE", 700)
    monkeypatch.setattr(blocking, "BLOCK_KEYS", 500)
    monkeypatch.setattr(blocking, "TARGETS_AT_ONCE", 5)
    rng = random.Random(4)
    word = lambda: f"w{int(rng.random() ** 3 * 400)}"
    base = [word() for _ in range(12)]
    docs = [(i, " ".join([*base[: rng.randrange(4, 12)], *(word() for _ in range(rng.randrange(12)))]), rng.choice(["en", "de"])) for i in range(90)]
    docs += [(i, " ".join(word() for _ in range(9)), "en") for i in range(100, 130)]
    docs += [(7, "w1 w2 own words here", "de"), (7, "w1 w2 own words here", "en"), (8, docs[8][1], docs[8][2]), (200, "", "en"), (201, "!", "de")]
    sf = tables(tmp_path, docs)
    assert spark_rows(queries.QUERIES[name](spark, sf)) == rows(queries.ORACLE_SQL[name], sf)


def test_blocking_makes_no_row_of_a_pair_that_shares_a_key(spark, sf, monkeypatch):
    """Pairs leave the tasks only as the best of a target and block."""
    made = []
    kept = blocking.materialize
    monkeypatch.setattr(blocking, "materialize", lambda d: made.append(kept(d)) or made[-1])
    queries.QUERIES["block_name_key"](spark, sf)
    pairs = [d for d in made if d.columns == ["a", "b", "cos"]]
    assert pairs and sum(d.count() for d in pairs) <= 10 * 200 + 500
