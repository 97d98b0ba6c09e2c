"""The 41 features of a candidate pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.similarity import similarity
from recordloom.functions.text import words

from .blocking import CHANNELS

FIELDS = ("name", "compact", "skel", "addr", "nums", "state", "legal")
#: name -> (kernel, field)
SIMILARITIES = {
    "n_ratio": ("ratio", "name"), "n_tset": ("set", "name"), "n_tsort": ("sorted", "name"), "n_partial": ("partial", "name"),
    "c_ratio": ("ratio", "compact"), "c_partial": ("partial", "compact"), "c_jw": ("jaro_winkler", "compact"),
    "k_ratio": ("ratio", "skel"), "k_tset": ("set", "skel"), "a_ratio": ("ratio", "addr"), "a_tset": ("set", "addr"), "a_partial": ("partial", "addr"),
}
OVERLAPS = {"num": "nums", "addr_word": "addr", "name_tok": "name"}
FEATURES = (
    *CHANNELS, "pf_name", "pf_addr", "pf_score", "pf_rank", *SIMILARITIES,
    *[f"{n}_{k}" for n in OVERLAPS for k in ("shared", "jac")],
    "num_first_eq", "t_has_num", "t_addr_empty_i", "state_eq", "legal_eq", "t_name_len", "s_name_len", "t_name_ntok", "is_s3",
    "pf_gap", "n_tset_gap", "a_tset_gap", "n_cands", "s1_top1_count",
)


def with_context(pairs: DataFrame) -> DataFrame:
    """Adds ``s1_top1_count``: the targets that rank this reference record first."""
    top = pairs.where(F.col("pf_rank") == 1).groupBy("s1").agg(F.count(F.lit(1)).cast("int").alias("s1_top1_count"))
    return pairs.join(top, "s1", "left").withColumn("s1_top1_count", F.coalesce("s1_top1_count", F.lit(0)))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Shared distinct words, and their share of all distinct words."""
    x, y = words(a), words(b)
    shared, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return shared.cast("double"), shared / F.greatest(every, F.lit(1))


def same_or_unknown(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), -1).otherwise((a == b).cast("int"))


def pair_features(pairs: DataFrame, reference: DataFrame, targets: DataFrame) -> DataFrame:
    """``tid, s1, t_country`` and FEATURES. ``pairs`` are ranked candidates with context; similarities share one visit to Python."""
    t = targets.select(F.col("entity_id").alias("tid"), F.col("country").alias("t_country"), F.col("addr_empty").alias("t_addr_empty"), *[F.col(f).alias(f"t_{f}") for f in FIELDS])
    s = reference.select(F.col("entity_id").alias("s1"), *[F.col(f).alias(f"s_{f}") for f in FIELDS])
    d = pairs.join(t, "tid", "left").join(s, "s1", "left")
    c = F.col
    d = d.withColumns({n: similarity(k, c(f"t_{f}"), c(f"s_{f}")) for n, (k, f) in SIMILARITIES.items()})
    made = {}
    for n, f in OVERLAPS.items():
        made[f"{n}_shared"], made[f"{n}_jac"] = overlap(c(f"t_{f}"), c(f"s_{f}"))
    has_num = c("t_nums") != ""
    made |= {
        "num_first_eq": (has_num & (F.split("t_nums", " ")[0] == F.split("s_nums", " ")[0])).cast("int"),
        "t_has_num": has_num.cast("int"),
        "t_addr_empty_i": c("t_addr_empty").cast("int"),
        "state_eq": same_or_unknown(c("t_state"), c("s_state")),
        "legal_eq": same_or_unknown(c("t_legal"), c("s_legal")),
        "t_name_len": F.length("t_name"),
        "s_name_len": F.length("s_name"),
        "t_name_ntok": F.regexp_count("t_name", F.lit(" ")) + 1,
        "is_s3": c("tid").startswith("S3").cast("int"),
    }
    d = d.withColumns(made)
    w = Window.partitionBy("tid")
    d = d.withColumns({**{f"{g}_gap": F.max(x).over(w) - c(x) for g, x in (("pf", "pf_score"), ("n_tset", "n_tset"), ("a_tset", "a_tset"))}, "n_cands": F.count(F.lit(1)).over(w).cast("int")})
    return d.select("tid", "s1", "t_country", *FEATURES)
