"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing, one after the other.

Each stage takes the documents that the stage before kept and returns documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import common, mixing, packing, quality_rules, secret_scans, similar, tokens


def _stage(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        out = f(docs)
        return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out

    return run_stage


@_stage
def quality(docs: DataFrame) -> DataFrame:
    """Documents that fail the rules go; others lose their host's frequent lines. Copies count once: the next stage needs one of them.

    Null, empty and blank texts fail. Rows without a source are one host. Repeated rows stay or go together; an empty table stays empty.
    """
    return quality_rules.passing_documents(docs, distinct_texts=True)


@_stage
def near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of similar texts stays: five-word shingles, Jaccard similarity of 0.8 at least.

    The smallest id of a group stays, one without an id only if there is no other; of repeated rows one stays. Null, empty and blank texts are one group.
    """
    return similar.one_of_each(docs)


@_stage
def secrets(docs: DataFrame) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay, also null and empty texts, repeated rows, and rows without a source or language."""
    return secret_scans.without_secrets(docs)


@_stage
def mix(docs: DataFrame) -> DataFrame:
    """The mix of sources at their target weights.

    Rows without a source are a source. Null, empty and blank texts have no words and no row; repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs)


@_stage
def pack(docs: DataFrame) -> DataFrame:
    """Pieces of the mixed texts' ids, packed into sequences. Null and empty texts are the end id alone; ids may be null; an empty table gives no pieces."""
    return packing.pack(common.materialize(packing.tokenize_pieces(docs, tokens.public_path("word_bpe_49k.json"))))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Fingerprints, permutations and token ids have no SQL; tests hold each stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written and read again.

    A stage's work folders go when its rows are written, and its rows when the next stage's are. They belong to this run alone: the result
    of a former or concurrent run stays readable. What the last stage reads goes when nothing reads the result any more.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        with common.watched() as made:
            docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            with common.watched() as written:
                docs = common.materialize(docs)
            common.delete(spark, *made, *before)
            before = written
    return docs
