import pytest
from pyspark.sql import functions as F

from recordloom.functions import lexicon, text

NAMES = [
    ("6eneral Motors LLC", "general motors", "llc", "knrl ntrs"),
    ("W0rldwide", "worldwide", "", "brltbt"),
    ("Nagaya Nagaya", "nagaya", "", "nk"),
    ("vijay technology", "vijay technology", "", "bk tknlk"),
    ("vijy teknoloji", "vijy teknoloji", "", "bk tknlk"),
    ("prime consultancy", "prime consultancy", "", "prn knsltns"),
    ("praim kmsltemsi", "praim kmsltemsi", "", "prn knsltns"),
    ("shiva finance", "shiva finance", "", "sb fns"),
    ("siva phainans", "siva phainans", "", "sb fns"),
    ("Acme piraivet limitet", "acme", "ltd pvt", "kn"),
    ("AT&T", "at t", "", "t t"),
    ("www.acme.com", "acme", "", "kn"),
    ("Belozeta f/k/a", "belozeta", "", "blst"),
    ("Lindy Foods", "foods", "ltd", "fts"),
    ("The Company", "", "co", ""),
    ("Ely LLC Ely", "ely", "llc", "l"),
    ("Smith.Co Ltd", "smith", "ltd", "snt"),
    (None, "", "", ""),
    ("", "", "", ""),
]
ADDRESSES = [
    ("Suite 5, 0012B Main St., Columbus, Ohio 43004", "US", "main street columbus", "5 12b 43004", "oh"),
    ("<NULL>", "X", "", "", ""),
    ("14 R. St Pierre, Nantes", "France", "rue saint pierre nantes", "14", ""),
    ("12th Road No. 7", "India", "road", "12 7", ""),
    ("A-101, Plot 5, M.G. Road", "India", "road", "101 5", ""),
    ("Washington Street, Seattle, Washington 98101", "US", "street seattle", "98101", "wa"),
    ("N/A", "X", "n", "", ""),
    ("West Virginia 000", "US", "", "0", "wv"),
    (None, None, "", "", ""),
]


def test_names(spark):
    d = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NAMES)], "i int, x string").select("i", text.normalize_name(F.col("x")).alias("n"))
    for r in d.collect():
        assert (NAMES[r.i][0], *r.n) == NAMES[r.i]


def test_addresses(spark):
    d = spark.createDataFrame([(i, *a[:2]) for i, a in enumerate(ADDRESSES)], "i int, x string, c string").select("i", text.normalize_address(F.col("x"), F.col("c")).alias("n"))
    for r in d.collect():
        assert (*ADDRESSES[r.i][:2], *r.n) == ADDRESSES[r.i]


def test_other_scripts(spark):
    d = spark.createDataFrame([("Café Ñandú",), ("विजय",), ("Straße",)], "x string").select(text.to_ascii(F.col("x")).alias("a"))
    assert [r.a for r in d.collect()] == ["cafe nandu", "vijy", "strase"]


def test_records(spark):
    d = text.normalize_records(spark.createDataFrame([("S1-1", "Acme Inc", "", "US"), ("S1-2", None, "N/A", None)], "entity_id string, business_name string, business_address string, country string"))
    a, b = sorted(d.collect(), key=lambda r: r.entity_id)
    assert (a["name"], a.compact, a.legal, a.addr_empty) == ("acme", "acme", "inc", True)
    assert (b["name"], b.addr, b.addr_empty) == ("", "n", False)


def test_spoken_legal_words_have_their_skeletons(spark):
    got = spark.range(1).select(*[text.skeleton_token(F.lit(w)).alias(w) for w in lexicon.SPOKEN_LEGAL]).first().asDict()
    assert {got[w]: c for w, c in lexicon.SPOKEN_LEGAL.items()} == text.SPOKEN_SKELETONS
    assert got["limited"] == got["limitad"]


def test_let_evaluates_once(spark):
    assert spark.range(1).select(text.let(F.lit(3), lambda x: x * x).alias("v")).first().v == 9


@pytest.mark.parametrize("x,want", [("a  b", ["a", "b"]), ("", []), (" a ", ["a"])])
def test_words(spark, x, want):
    assert spark.createDataFrame([(x,)], "x string").select(text.words(F.col("x")).alias("w")).first().w == want
