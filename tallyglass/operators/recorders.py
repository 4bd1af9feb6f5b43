"""Typed records fanned out to metric points ``(ts, type, name, value, metadata, tags)``.

Each kind of record has a function from columns to an array of points, so that a mixed
table is fanned out in one pass, and one from a table of such records to points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = ["ts", "metric_type", "metric_name", "value", "metadata", "tags"]
POINT_TYPE = (
    "array<struct<metric_type:string,metric_name:string,value:double,metadata:string,"
    "tags:map<string,string>>>"
)


def _none() -> Column:
    return F.lit(None).cast("string")


def _points(measures: list[tuple[str, str | Column, Column, Column]], tags: Column) -> Column:
    """One point per measure (type, name, value, metadata)."""
    rows = [
        F.struct(
            F.lit(type_).alias("metric_type"),
            (F.lit(name) if isinstance(name, str) else name).alias("metric_name"),
            value.cast("double").alias("value"),
            metadata.alias("metadata"),
            tags.alias("tags"),
        )
        for type_, name, value, metadata in measures
    ]
    return F.array(*rows).cast(POINT_TYPE)


def fan_out(records: DataFrame, points: Column) -> DataFrame:
    """One output row per record and point; each record is read once."""
    return records.select("ts", F.explode(points).alias("_p")).select("ts", "_p.*").select(*POINT)


def no_points() -> Column:
    return F.array().cast(POINT_TYPE)


def _tag(name: str, value: Column) -> Column:
    return F.create_map(F.lit(name), value.cast("string"))


def _no_tags() -> Column:
    return F.lit(None).cast("map<string,string>")


def complexity_rows(
    file_path: Column, cyclomatic: Column, cognitive: Column, maintainability: Column
) -> Column:
    measures = [
        ("quality", "cyclomatic_complexity", cyclomatic, _none()),
        ("quality", "cognitive_complexity", cognitive, _none()),
        ("quality", "maintainability_index", maintainability, _none()),
    ]
    return _points(measures, _tag("file_path", file_path))


def security_rows(file_path: Column, issues: Column) -> Column:
    detail = F.to_json(F.struct(issues.alias("issues")))
    measures = [("security", "security_issues_count", F.size(issues), detail)]
    return _points(measures, _tag("file_path", file_path))


def smell_rows(file_path: Column, smells: Column) -> Column:
    detail = F.to_json(F.struct(smells.alias("smells")))
    measures = [("quality", "code_smells_count", F.size(smells), detail)]
    return _points(measures, _tag("file_path", file_path))


def analysis_rows(project_path: Column, seconds: Column, files: Column) -> Column:
    detail = F.to_json(F.struct(files.alias("files_processed")))
    rate = files / F.greatest(seconds, F.lit(0.001))
    measures = [
        ("performance", "analysis_time", seconds, detail),
        ("performance", "files_per_second", rate, _none()),
    ]
    return _points(measures, _tag("project_path", project_path))


def embedding_rows(code_size: Column, seconds: Column) -> Column:
    detail = F.to_json(F.struct(code_size.alias("code_size")))
    measures = [("performance", "embedding_generation_time", seconds, detail)]
    return _points(measures, _tag("operation", F.lit("embedding")))


def test_rows(framework: Column, total: Column, passed: Column, seconds: Column) -> Column:
    measures = [
        ("testing", "total_tests", total, _none()),
        ("testing", "test_success_rate", passed / F.greatest(total, F.lit(1)), _none()),
        ("testing", "test_execution_time", seconds, _none()),
    ]
    return _points(measures, _tag("framework", framework))


def command_rows(command: Column, seconds: Column, success: Column) -> Column:
    parts = [command.alias("command"), seconds.alias("execution_time"), success.alias("success")]
    measures = [("usage", "command_usage", success.cast("int"), F.to_json(F.struct(*parts)))]
    return _points(measures, _no_tags())


def license_rows(license_type: Column, success: Column) -> Column:
    measures = [("usage", "license_validation", success.cast("int"), _none())]
    return _points(measures, _tag("license_type", license_type))


def operation_rows(operation: Column, seconds: Column, metadata: Column) -> Column:
    """Timed operations become ``<operation>_time`` performance points."""
    name = F.concat(operation, F.lit("_time"))
    return _points([("performance", name, seconds, metadata)], _no_tags())


def _columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def complexity_points(records: DataFrame) -> DataFrame:
    names = ("file_path", "cyclomatic_complexity", "cognitive_complexity", "maintainability_index")
    return fan_out(records, complexity_rows(*_columns(*names)))


def security_points(records: DataFrame) -> DataFrame:
    return fan_out(records, security_rows(*_columns("file_path", "issues")))


def smell_points(records: DataFrame) -> DataFrame:
    return fan_out(records, smell_rows(*_columns("file_path", "smells")))


def analysis_points(records: DataFrame) -> DataFrame:
    names = ("project_path", "analysis_time", "files_processed")
    return fan_out(records, analysis_rows(*_columns(*names)))


def embedding_points(records: DataFrame) -> DataFrame:
    return fan_out(records, embedding_rows(*_columns("code_size", "embedding_time")))


def test_points(records: DataFrame) -> DataFrame:
    names = ("framework", "total_tests", "passed_tests", "execution_time")
    return fan_out(records, test_rows(*_columns(*names)))


def command_points(records: DataFrame) -> DataFrame:
    return fan_out(records, command_rows(*_columns("command", "execution_time", "success")))


def license_points(records: DataFrame) -> DataFrame:
    return fan_out(records, license_rows(*_columns("license_type", "success")))


def operation_points(records: DataFrame) -> DataFrame:
    return fan_out(records, operation_rows(*_columns("operation", "duration", "metadata")))
