"""Text operators over the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import texts
from .registry import query, rounded, table

BLANK_SQL = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
WORD_SQL = r"[\p{L}\p{N}_]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern_sql(pattern: str) -> str:
    """The pattern without look-behind, for an engine that has none."""
    before = rf"(?:\A|[^\p{{L}}\p{{N}}_])"
    return pattern.replace(rf"(?<!{t.WORD})", before).replace(t.BLANK, BLANK_SQL)


def issues_sql(text: str = "text") -> str:
    cases = ",\n    ".join(
        f"CASE WHEN regexp_matches({text}, {quoted('(?i)' + pattern_sql(p))}) "
        f"THEN {quoted(m)} END"
        for p, m, _ in t.SECURITY_PATTERNS
    )
    return f"[m for m in [{cases}] if m IS NOT NULL]"


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.content_hash(table(spark, sf_dir, "documents"), "doc_id")


@query(
    "line_counts",
    rf"""WITH cut AS (
  SELECT doc_id, [regexp_replace(l, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')
    for l in string_split(text, chr(10))] AS ls FROM documents)
SELECT doc_id, len(ls) AS lines,
  len([l for l in ls if l <> '' AND NOT starts_with(l, '#')]) AS loc,
  len([l for l in ls if starts_with(l, '#')]) AS comments,
  round(len([l for l in ls if starts_with(l, '#')]) / len(ls), 8) AS comment_ratio
FROM cut""",
)
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texts.line_counts(table(spark, sf_dir, "documents"), "doc_id"), "comment_ratio")


@query(
    "security_scan",
    f"""WITH found AS (SELECT doc_id, {issues_sql()} AS issues FROM documents)
SELECT doc_id, unnest(range(len(issues))) AS position, unnest(issues) AS issue FROM found""",
)
def security_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.security_scan(table(spark, sf_dir, "documents"), "doc_id")


@query(
    "smell_duplicate_line",
    rf"""WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, unnest(ls) AS txt, unnest(range(1, len(ls) + 1)) AS pos FROM cut)
SELECT doc_id, min(first_pos) AS line FROM (
  SELECT doc_id, min(pos) AS first_pos FROM numbered
  WHERE length(regexp_replace(txt, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')) > 20
  GROUP BY doc_id, txt HAVING count(*) > 2) GROUP BY doc_id""",
)
def smell_duplicate_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.repeated_lines(table(spark, sf_dir, "documents"), "doc_id")


@query(
    "token_features",
    rf"""SELECT doc_id, token, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '{WORD_SQL}+|[^\p{{L}}\p{{N}}_]')) AS token
  FROM documents) GROUP BY doc_id, token""",
)
def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts.token_features(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", "token", F.col("n"))
