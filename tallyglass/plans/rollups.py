"""Queries over stored roll-ups of metric points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups
from ..session import work_folder
from .fixtures import POINTS_SQL, metric_points, recorded_points
from .holes import POINTS_SQL as HOLES_SQL
from .holes import points as points_with_holes
from .registry import at, query, rounded
from .timeseries import (
    AS_OF,
    FLOATS,
    HOURS,
    KEY_SQL,
    MINUTES,
    ROUNDED_SQL,
    SHOWN,
    USAGE_SQL,
    overview_sql,
    tumbling_sql,
)


def stored_minutes(points: DataFrame) -> str:
    """A folder with the points' minute counts, arrived in two batches, one of them twice."""
    folder = work_folder(points.sparkSession, "rollups")
    early = F.coalesce(F.col("value") < 20, F.lit(True))
    for batch, some in (("early", early), ("late", ~early), ("late", ~early)):
        rollups.rollup_append(points.where(some), folder, batch)
    return folder


def _register(name: str, level: str, source_sql: str, source) -> None:
    sql = f"WITH {source_sql}, {tumbling_sql(level)} SELECT {KEY_SQL}, count, {ROUNDED_SQL} FROM aggs"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """From minutes to hours, days and on, each level from the stored one below."""
        folder = stored_minutes(source(spark, sf_dir))
        chain = [level]
        while (finer := rollups.FINER[chain[0]]) != "minute":
            chain.insert(0, finer)
        for step in chain:
            rollups.rollup_level(spark, folder, step)
        counts = rollups.rollup_counts(spark, folder, level)
        return rounded(rollups.aggregates_of_counts(counts, level), *FLOATS)


_register("rollup_day", "day", POINTS_SQL, metric_points)
_register("rollup_month", "month", POINTS_SQL, metric_points)
_register("rollup_week_holes", "week", HOLES_SQL, points_with_holes)


@query(
    "metrics_report_rollup",
    f"""{MINUTES}, shown AS ({overview_sql(["quality", "performance", "testing"])}),
used AS ({USAGE_SQL})
SELECT * FROM shown UNION ALL BY NAME SELECT * FROM used""",
)
def metrics_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard report from stored minute counts."""
    folder = stored_minutes(recorded_points(spark, sf_dir))
    counts = rollups.rollup_counts(spark, folder, "minute", at("2024-01-01 00:00:00"), at(AS_OF))
    return rounded(rollups.report_of_counts(counts, at(AS_OF), HOURS), *SHOWN, "success_rate")
