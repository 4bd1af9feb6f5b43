"""Bounded samples of labelled documents, and the fold that is never learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import quoted

FOLDS = 5


def held_out(id: Column) -> Column:
    """Is the document outside the training folds?  A null id counts as an empty text."""
    name = F.coalesce(id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(name) % F.lit(FOLDS) == 0


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, id: str, text: str, most: int
) -> DataFrame:
    """Columns ``order``, ``label`` (0 or 1) and ``text``, one row for each of at most
    ``most`` labelled ids.

    The ids with the smallest hash are taken, an id with several labels at its largest.
    The chosen ids are at most ``most`` narrow rows, so they are broadcast.  An id found in
    several rows is one document: the text with the smallest hash stands for it.  Each task
    keeps one text an id before the shuffle, so a hot id does not meet in one task.
    """
    known = labels.select(
        F.col(quoted(id)).alias("_labelled"), (F.col(quoted(label)) > 0).cast("int").alias("label")
    ).dropna()
    chosen = (
        known.groupBy("_labelled")
        .agg(F.max("label").alias("label"))
        .withColumn("order", F.xxhash64("_labelled"))
        .orderBy("order", "_labelled")
        .limit(most)
    )
    texts = docs.select(F.col(quoted(id)).alias("_id"), F.col(quoted(text)).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_labelled"))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    return (
        found.groupBy("_labelled", "order", "label")
        .agg(first.alias("first"))
        .select("order", "label", F.col("first.text").alias("text"))
    )
