"""A corpus pipeline: each stage reads what the stage before it kept.

All stages but the last give the columns of their documents, whatever their names.  Nulls
in any column stay as they are; a null text counts as empty.  Texts of any length are read
whole, repeated rows are decided one by one or as copies of each other, and an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tallyglass.llm import bpe, exact_dedup, near_dups, packing, quality_model, quality_rules
from tallyglass.llm.queries import LEAST_QUALITY, WORD_FILE, train_labels, vocabulary
from tallyglass.llm.ragged import where_made
from tallyglass.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject.

    Documents without a label, an id or a word are scored like all others; equal texts are
    kept or rejected alike, and a score equal to the limit keeps.
    """
    model = quality_model.fit(docs, train_labels(spark, sf_dir), "quality")

    def good(rows: DataFrame, text: str) -> DataFrame:
        return quality_model.score(rows, model, text).where(F.col("score") >= LEAST_QUALITY)

    return where_made(docs, "text", good)


def keep_regular(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the newest policy.

    A null or empty text has no words and fails the rule on few words.
    """

    def regular(rows: DataFrame, text: str) -> DataFrame:
        return quality_rules.ledger(rows, text).where(~quality_rules.fails("2"))

    return where_made(docs, "text", regular)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside.

    The one of most code points stays, then the smallest id, a null id last; of rows that
    are equal in both one stays.
    """
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id, null last.

    Texts without words are one group; of repeated rows one stays.
    """
    return near_dups.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096: one row per piece of a document, with its ids.

    Also an empty document has a piece, which holds its end mark.
    """
    coded = bpe.encode(docs, vocabulary(WORD_FILE), keep=["doc_id"])
    return packing.pack(coded, keep=["doc_id"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("quality_rules", keep_regular),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

# Training and tokenising are beyond SQL; tests/llm compares run() with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
