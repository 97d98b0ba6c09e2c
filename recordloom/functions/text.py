"""Name and address normalization as Column expressions; only non-ASCII text visits a Python worker."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recordloom.session import ship_to_active

from . import lexicon as lex


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def words(x: Column) -> Column:
    """The non-empty parts between spaces."""
    return F.filter(F.split(x, " "), lambda t: t != "")


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def any_of(d) -> Column:
    return F.array(*[F.lit(x) for x in d])


def _letters(text: str) -> str:
    """Latin letters for a text: accents go, and a letter of another script gives what its Unicode name spells."""
    out = []
    for c in unicodedata.normalize("NFKD", text):
        if c.isascii():
            out.append(c)
        elif unicodedata.combining(c) or unicodedata.category(c) == "Mn":
            name = unicodedata.name(c, "")
            if "VOWEL SIGN" in name:
                out.append(name.rsplit(" ", 1)[-1].lower())
        elif unicodedata.category(c)[0] in "PSZ":
            out.append("'" if c in "\u2018\u2019\u02bc\u2032" else " ")
        else:
            name = unicodedata.name(c, "")
            kind = next((k for k in (" LETTER ", " LIGATURE ", " DIGIT ", " VOWEL SIGN ") if k in name), None)
            if kind == " DIGIT ":
                out.append(str(unicodedata.digit(c, 0)))
            elif kind:
                sound = name.split(kind)[1].split(" WITH ")[0].rsplit(" ", 1)[-1].lower()
                indic = name.split(" ", 1)[0] in ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
                out.append(sound[:-1] if indic and len(sound) > 1 and sound.endswith("a") and sound not in ("aa",) else sound)
    return "".join(out)


@F.pandas_udf(StringType())
def _transliterate(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _letters(x).lower(), na_action="ignore")


def to_ascii(x: Column) -> Column:
    """Lower case, in Latin letters. ASCII text stays in the JVM."""
    ship_to_active()
    low = F.lower(x)
    return F.when(low.rlike(r"^[\x00-\x7F]*$"), low).otherwise(_transliterate(F.when(~low.rlike(r"^[\x00-\x7F]*$"), low)))


def skeleton_token(t: Column) -> Column:
    """Consonants of a word by its sound."""
    t = reduce(lambda x, r: F.regexp_replace(x, *r), lex.SKELETON_REWRITES, t)
    return F.regexp_replace(F.translate(t, lex.SKELETON_FROM, lex.SKELETON_TO), r"(.)\1+", "$1")


def skeleton(clean: Column) -> Column:
    """The skeletons of a clean name's words; a word without consonants gives its first letter."""
    return F.array_join(F.transform(words(clean), lambda t: let(skeleton_token(t), lambda k: F.when(k == "", F.substring(t, 1, 1)).otherwise(k))), " ")


def name_tokens(x: Column) -> Column:
    """Structs (t, legal, class) of a raw name's words, in order."""
    s = to_ascii(x)
    s = F.regexp_replace(s, r"https?://|www\.", " ")
    s = F.regexp_replace(s, r"\.(?:com|c0m|co\.in|net|org|in|fr|co|biz|info|io|us)\b", " ")
    s = F.regexp_replace(s, r"\b(?:f/k/a|a/k/a|d/b/a|fka|aka|dba|formerly)\b", " ")
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus "))
    s = F.regexp_replace(F.translate(s, ".'`’", ""), "[^a-z0-9]+", " ")
    read = lambda t: F.when(t.rlike("[0-9]") & t.rlike("[a-z]"), F.translate(t, lex.OCR_DIGITS, lex.OCR_LETTERS)).otherwise(t)
    classes, spoken = literal_map(lex.LEGAL_CLASSES), literal_map(SPOKEN_SKELETONS)

    def tag(t: Column) -> Column:
        listed = F.array_contains(any_of(lex.LEGAL_WORDS), t)
        said = F.when(F.length(t) >= 5, F.try_element_at(spoken, skeleton_token(t)))
        return F.struct(t.alias("t"), (listed | said.isNotNull()).alias("legal"), F.when(listed, F.try_element_at(classes, t)).otherwise(said).alias("class"))

    return F.transform(F.transform(words(s), read), tag)


#: Skeletons of the spoken legal words, by the rules above (private, limited, corporation, company, incorporated, limitad).
SPOKEN_SKELETONS = {"prbt": "pvt", "lnt": "ltd", "krprtn": "inc", "knpn": "co", "nkrprt": "inc"}


def normalize_name(x: Column) -> Column:
    """Struct (name, legal, skel) of a raw name; a null is empty."""

    def finish(toks: Column) -> Column:
        kept = F.transform(F.filter(toks, lambda s: ~s["legal"]), lambda s: s["t"])
        none = F.array().cast("array<string>")
        once = F.aggregate(kept, none, lambda a, t: F.when(F.try_element_at(a, F.lit(-1)) == t, a).otherwise(F.concat(a, F.array(t))))
        classes = F.array_sort(F.array_distinct(F.filter(F.transform(toks, lambda s: s["class"]), lambda c: c.isNotNull())))
        return let(F.array_join(once, " "), lambda n: F.struct(n.alias("name"), F.array_join(classes, " ").alias("legal"), skeleton(n).alias("skel")))

    return let(name_tokens(F.coalesce(x, F.lit(""))), finish)


def _without_zeros(x: Column) -> Column:
    return F.regexp_replace(x, "^0+(?=.)", "")


def normalize_address(x: Column, country: Column) -> Column:
    """Struct (addr, nums, state) of a raw address. ``US`` folds states, ``France`` has abbreviations of its own."""
    s = F.replace(to_ascii(F.coalesce(x, F.lit(""))), F.lit("<null>"), F.lit(" "))
    folded = reduce(lambda c, n: F.regexp_replace(c, rf"\b{n}\b", lex.US_STATES[n]), sorted(lex.US_STATES, key=len, reverse=True), s)
    us, french = F.coalesce(country == "US", F.lit(False)), F.coalesce(country == "France", F.lit(False))
    s = F.regexp_replace(F.when(us, folded).otherwise(s), "[^a-z0-9]+", " ")
    codes = any_of(sorted(set(lex.US_STATES.values())))
    digit = lambda t: t.rlike("[0-9]")

    def expand(t: Column) -> Column:
        common = F.coalesce(F.try_element_at(literal_map(lex.ADDRESS_WORDS), t), t)
        return F.when(french, F.coalesce(F.try_element_at(literal_map(lex.FRENCH_WORDS), t), common)).otherwise(common)

    def finish(toks: Column) -> Column:
        one = lambda t: F.when(t.rlike("^[0-9]+[a-z]?$|^[a-z]?[0-9]+$"), F.array(t)).otherwise(F.regexp_extract_all(t, F.lit("([0-9]+)")))
        nums = F.array_distinct(F.transform(F.flatten(F.transform(F.filter(toks, digit), one)), _without_zeros))
        plain = F.filter(toks, lambda t: ~digit(t))
        is_code = lambda t: us & F.array_contains(codes, t)
        state = F.coalesce(F.try_element_at(F.filter(plain, is_code), F.lit(-1)), F.lit(""))
        kept = F.filter(F.transform(F.filter(plain, lambda t: ~is_code(t)), expand), lambda t: (t != "") & ~F.array_contains(any_of(lex.ADDRESS_DROPS), t) & ((F.length(t) > 1) | t.isin("n", "s", "e", "w")))
        return F.struct(F.array_join(kept, " ").alias("addr"), F.array_join(nums, " ").alias("nums"), state.alias("state"))

    return let(words(s), finish)


def normalize_records(df: DataFrame, id_col: str = "entity_id", name_col: str = "business_name", address_col: str = "business_address", country_col: str = "country") -> DataFrame:
    """``entity_id, country, name, legal, skel, addr, nums, state, compact, addr_empty`` for each record, in one projection."""
    d = df.select(F.col(id_col).alias("entity_id"), F.col(country_col).alias("country"), normalize_name(F.col(name_col)).alias("n"), normalize_address(F.col(address_col), F.col(country_col)).alias("a"))
    d = d.select("entity_id", "country", "n.name", "n.legal", "n.skel", "a.addr", "a.nums", "a.state")
    return d.withColumns({"compact": F.replace("name", F.lit(" "), F.lit("")), "addr_empty": (F.col("addr") == "") & (F.col("nums") == "")})
