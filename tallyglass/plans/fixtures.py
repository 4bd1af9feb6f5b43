"""Logical tables derived from the ``events`` table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recorders
from .registry import table

# Metric type of each event type (fixed values of the fixture).
TYPE_OF = {
    "click": "usage",
    "error": "quality",
    "purchase": "performance",
    "signup": "security",
    "view": "testing",
}
TYPE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_OF.items()) + " END"


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric points: name = event type."""
    events = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in TYPE_OF.items() for x in pair])
    return events.select(
        "ts",
        kind[F.col("event_type")].alias("metric_type"),
        F.col("event_type").alias("metric_name"),
        "value",
        F.col("props").alias("metadata"),
        F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("tags"),
    )


POINTS_SQL = f"""points AS (
  SELECT ts, {TYPE_SQL} AS metric_type, event_type AS metric_name, value, props, user_id
  FROM events)"""


def recorded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records derived from events, all fanned out in one pass over the table."""
    events = table(spark, sf_dir, "events")
    value, event = F.col("value"), F.col("event_id")
    whole = F.floor("value").cast("int")
    path = F.concat(F.lit("src/f"), F.pmod("user_id", F.lit(7)).cast("string"), F.lit(".py"))

    def some(word: str, most: int) -> Column:
        return F.array_repeat(F.lit(word), F.pmod(event, F.lit(most)).cast("int"))

    kinds = {
        "click": [
            recorders.complexity_rows(path, whole, whole * 2, F.lit(100) - value),
            recorders.command_rows(F.lit("find"), value, F.pmod(event, F.lit(3)) > 0),
        ],
        "purchase": [
            recorders.security_rows(path, some("issue", 4)),
            recorders.smell_rows(path, some("smell", 3)),
        ],
        "view": [
            recorders.analysis_rows(F.lit("proj"), value - 1, F.pmod(event, F.lit(50))),
            recorders.operation_rows(
                F.lit("file_analysis"), value, F.lit(None).cast("string")
            ),
        ],
        "signup": [
            recorders.embedding_rows(whole, value),
            recorders.license_rows(F.lit("trial"), F.pmod(event, F.lit(4)) > 0),
        ],
        "error": [
            recorders.test_rows(
                F.lit("pytest"), F.pmod(event, F.lit(10)), F.pmod(event, F.lit(5)), value
            )
        ],
    }
    points = recorders.no_points()
    for kind, arrays in kinds.items():
        points = F.when(F.col("event_type") == kind, F.concat(*arrays)).otherwise(points)
    return recorders.fan_out(events, points)


_WORDS_SQL = """'{{"{key}":[' || rtrim(repeat('"{word}",', event_id % {most}), ',') || ']}}'"""


def _record_sql(kind: str, type_: str, name: str, value: str, metadata: str, tag: str, text: str) -> str:
    """One kind of point; the tag is its name and value, both empty without tags."""
    return f"""SELECT ts, '{type_}' AS metric_type, '{name}' AS metric_name,
    CAST({value} AS DOUBLE) AS value, CAST({metadata} AS VARCHAR) AS metadata,
    {tag} AS tag, {text} AS tag_value FROM events WHERE event_type = '{kind}'"""


_PATH = ("'file_path'", "'src/f' || user_id % 7 || '.py'")
_NO_TAG = ("NULL", "NULL")
_COMMAND = """'{"command":"find","execution_time":' || value || ',"success":' || (event_id % 3 > 0) || '}'"""
RECORDED_SQL = "recorded AS (" + "\n  UNION ALL ".join(
    _record_sql(*row)
    for row in [
        ("click", "quality", "cyclomatic_complexity", "floor(value)", "NULL", *_PATH),
        ("click", "quality", "cognitive_complexity", "floor(value) * 2", "NULL", *_PATH),
        ("click", "quality", "maintainability_index", "100 - value", "NULL", *_PATH),
        ("purchase", "security", "security_issues_count", "event_id % 4",
         _WORDS_SQL.format(key="issues", most=4, word="issue"), *_PATH),
        ("purchase", "quality", "code_smells_count", "event_id % 3",
         _WORDS_SQL.format(key="smells", most=3, word="smell"), *_PATH),
        ("view", "performance", "analysis_time", "value - 1",
         """'{"files_processed":' || event_id % 50 || '}'""", "'project_path'", "'proj'"),
        ("view", "performance", "files_per_second",
         "(event_id % 50) / greatest(value - 1, 0.001)", "NULL", "'project_path'", "'proj'"),
        ("signup", "performance", "embedding_generation_time", "value",
         """'{"code_size":' || CAST(floor(value) AS INT) || '}'""", "'operation'", "'embedding'"),
        ("error", "testing", "total_tests", "event_id % 10", "NULL", "'framework'", "'pytest'"),
        ("error", "testing", "test_success_rate", "(event_id % 5) / greatest(event_id % 10, 1)",
         "NULL", "'framework'", "'pytest'"),
        ("error", "testing", "test_execution_time", "value", "NULL", "'framework'", "'pytest'"),
        ("click", "usage", "command_usage", "CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END",
         _COMMAND, *_NO_TAG),
        ("signup", "usage", "license_validation", "CASE WHEN event_id % 4 > 0 THEN 1 ELSE 0 END",
         "NULL", "'license_type'", "'trial'"),
        ("view", "performance", "file_analysis_time", "value", "NULL", *_NO_TAG),
    ]
) + ")"
