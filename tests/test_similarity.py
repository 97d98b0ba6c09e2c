from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import similarity as sim

short = st.text("abc d", max_size=9)


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(short, short)
@settings(max_examples=300, deadline=None)
def test_lcs(a, b):
    assert sim.lcs(a, b) == slow_lcs(a, b)


@given(short, short)
@settings(max_examples=300, deadline=None)
def test_partial_is_the_best_stretch(a, b):
    if a and b:
        pairs = [(a, b)] if len(a) < len(b) else [(b, a)] if len(b) < len(a) else [(a, b), (b, a)]
        windows = lambda m, n: [(0, i) for i in range(1, m)] + [(i, i + m) for i in range(n - m + 1)] + [(i, n) for i in range(n - m + 1, n)]
        best = max(sim.ratio(s, x[i:j]) for s, x in pairs for i, j in windows(len(s), len(x)))
        assert abs(sim.partial_ratio(a, b) - best) < 1e-12


@given(short, short)
@settings(max_examples=200, deadline=None)
def test_bounds_and_symmetry(a, b):
    for f in sim.KERNELS.values():
        assert 0 <= f(a, b) <= 1
        assert abs(f(a, b) - f(b, a)) < 1e-9
        if a.split():
            assert f(a, a) == 1


def test_known_values():
    assert sim.ratio("", "") == 1 and sim.ratio("", "a") == 0
    assert sim.set_ratio("", "") == 0 and sim.set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert sim.sorted_ratio("new york mets", "mets york new") == 1
    assert sim.partial_ratio("this is a test", "this is a test!") == 1
    assert round(sim.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(sim.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert sim.jaro_winkler("", "") == 1 and sim.jaro_winkler("", "a") == 0


def test_columns_and_nulls(spark):
    d = spark.createDataFrame([("ab", "ab"), (None, "a"), ("", "")], "a string, b string")
    got = [r.x for r in d.select(sim.similarity("ratio", F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [1.0, None, 1.0]
