"""Operators over any ``(id, text)`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def content_hash(docs: DataFrame, id_: str, text: str = "text") -> DataFrame:
    return docs.select(id_, t.content_hash(F.col(text)).alias("content_hash"))


def line_counts(docs: DataFrame, id_: str, text: str = "text") -> DataFrame:
    body = F.col(text)
    return docs.select(
        id_,
        F.size(t.lines(body)).alias("lines"),
        t.code_lines(body).alias("loc"),
        t.comment_lines(body).alias("comments"),
        t.comment_ratio(body).alias("comment_ratio"),
    )


def security_scan(
    docs: DataFrame,
    id_: str,
    text: str = "text",
    patterns: list[tuple[str, str, list[str]]] = t.SECURITY_PATTERNS,
) -> DataFrame:
    """One row per text and message found; ``patterns`` may be replaced."""
    issues = t.security_issues(F.col(text), patterns)
    return docs.select(id_, F.posexplode(issues).alias("position", "issue"))


def repeated_lines(docs: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """Texts with a long line occurring three times, and its first line number."""
    found = docs.select(id_, t.repeated_line(F.col(text)).alias("line"))
    return found.where(F.col("line").isNotNull())


def token_features(
    docs: DataFrame, id_: str, text: str = "text", max_chars: int | None = None
) -> DataFrame:
    """Count of every token per text, with the token's stable bucket.

    Texts are counted row by row, without a shuffle.
    """
    counted = docs.select(id_, F.inline(t.token_counts(F.col(text), max_chars)))
    return counted.withColumn("bucket", t.token_bucket(F.col("token")))
