"""Stored roll-ups: counts of values per minute, merged to hours, days, weeks and months.

Counts of distinct values merge without loss, so every granularity and every percentile
comes from the level below it and raw points are read once, when they arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panes import merged_panes, pane_counts
from ..functions.skew import newest_rows, small_side
from ..functions.stats import exact_percentiles, weighted_moments, weighted_stats
from ..functions.times import tumbling_start
from .timeseries import (
    AGG_KEY,
    PERCENTILES,
    SERIES,
    STATS,
    _shown,
    _wanted,
    trend_period,
    usage_of_minutes,
)

# Each granularity and the one it is merged from.
FINER = {"hour": "minute", "day": "hour", "week": "day", "month": "day"}
COUNTS = "metric_name string, metric_type string, pane timestamp_ntz, value double, n long, level string, day date, batch string"


def _write(counts: DataFrame, folder: str, level: str, batch: str) -> None:
    placed = counts.withColumns(
        {"level": F.lit(level), "day": F.to_date("pane"), "batch": F.lit(batch)}
    )
    (
        placed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("level", "day", "batch")
        .parquet(folder)
    )


def rollup_append(points: DataFrame, folder: str, batch: str) -> None:
    """Store the minute counts of a batch of points.

    A folder per day and batch: other batches add to the same minutes, and a batch that is
    repeated takes its own place.  Points without a value or a time count nowhere.
    """
    timed = points.where(F.col("ts").isNotNull())
    _write(pane_counts(timed, SERIES, tumbling_start(F.col("ts"), "minute")), folder, "minute", batch)


def rollup_counts(
    spark: SparkSession, folder: str, level: str, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Stored counts of a level; only the days of panes from ``start`` to ``end`` are read."""
    found = spark.read.schema(COUNTS).parquet(folder).where(F.col("level") == level)
    if start is not None:
        found = found.where((F.col("day") >= F.to_date(start)) & (F.col("pane") >= start))
    if end is not None:
        found = found.where((F.col("day") <= F.to_date(end)) & (F.col("pane") <= end))
    return found.select(*SERIES, "pane", "value", "n")


def rollup_level(spark: SparkSession, folder: str, level: str) -> None:
    """Merge a level from the stored one below it; what the level held before is replaced."""
    finer = rollup_counts(spark, folder, FINER[level])
    _write(merged_panes(finer, SERIES, tumbling_start(F.col("pane"), level)), folder, level, "merged")


def aggregates_of_counts(counts: DataFrame, level: str) -> DataFrame:
    """The rows of ``aggregate_tumbling`` from counts of panes of that granularity."""
    keyed = counts.withColumnRenamed("pane", "ts")
    # Batches that share a minute hold some values twice.
    merged = keyed.groupBy(*SERIES, "ts", "value").agg(F.sum("n").alias("n"))
    found = weighted_stats(merged, [*SERIES, "ts"])
    return found.withColumn("granularity", F.lit(level)).select(*AGG_KEY, *STATS)


def report_of_counts(counts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """All four dashboard sections from minute counts, which are read twice.

    One pass sums up the minutes; another looks at the values of each series' newest minute.
    """
    sections = ["quality", "performance", "testing"]
    start = trend_period(as_of, hours)
    inside = counts.where(F.col("pane").between(start, as_of))
    inside = inside.where(F.col("metric_name").isin(_wanted([*sections, "usage"])))
    weighted = F.col("n") * F.col("value")
    minutes = inside.groupBy(*SERIES, F.col("pane").alias("ts")).agg(
        F.sum("n").alias("count"),
        F.sum(weighted).alias("sum"),
        (F.sum(weighted) / F.sum("n")).alias("avg"),
    )
    minutes = minutes.withColumn("granularity", F.lit("minute"))
    own = minutes.where(F.col("metric_name").isin(_wanted(sections)))
    last_two = newest_rows(own, SERIES, [F.desc("ts")], 2)
    latest = last_two.groupBy(*SERIES).agg(
        F.max("ts").alias("pane"),
        F.when(F.count(F.lit(1)) == 2, F.min_by("avg", "ts")).alias("_previous"),
    )
    newest = inside.join(small_side(latest.select(*SERIES, "pane")), [*SERIES, "pane"])
    newest = newest.groupBy(*SERIES, "value").agg(F.sum("n").alias("n"))
    moments = weighted_moments(newest, SERIES)
    found = moments.join(exact_percentiles(newest, SERIES), SERIES)
    fields = F.struct("avg", "min", "max", "std", *PERCENTILES)
    summary = found.select(*SERIES, fields.alias("_new")).join(latest.drop("pane"), SERIES)
    return _shown(summary, sections).unionByName(usage_of_minutes(minutes), allowMissingColumns=True)
