"""Metric points, aggregates, trends and dashboards."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panes import pane_counts, point_moments, window_stats
from ..functions.scans import previous_value, running_total
from ..functions.skew import SMALL_ROWS, newest_rows
from ..functions.stats import PERCENTILES, exact_percentiles, frequency, grouped_stats, moments
from ..functions.times import (
    GRANULARITY_SECONDS,
    MICROS,
    epoch_micros,
    from_micros,
    seconds_interval,
    tumbling_start,
)
from ..session import stored

_EPOCH = dt.datetime(1970, 1, 1)
SERIES = ["metric_name", "metric_type"]
# A stored table holds several granularities; rows of one never meet those of another.
LEVEL = [*SERIES, "granularity"]
AGG_KEY = [*LEVEL, "ts"]
MOMENTS = ["count", "sum", "avg", "min", "max", "std"]
STATS = [*MOMENTS, *PERCENTILES]


def aggregate_tumbling(
    points: DataFrame, granularity: str, percentiles: bool = True
) -> DataFrame:
    """Statistics per series and aligned ``[start, end)`` bucket.

    Null values count nowhere; a bucket of nothing else has no row.  Without percentiles
    one partial aggregation is enough.
    """
    valued = points.where(F.col("value").isNotNull())
    keyed = valued.select(*SERIES, tumbling_start(F.col("ts"), granularity).alias("ts"), "value")
    keys = [*SERIES, "ts"]
    if percentiles:
        stats, columns = grouped_stats(keyed, keys), STATS
    else:
        stats, columns = keyed.groupBy(*keys).agg(*moments()), MOMENTS
    return stats.withColumn("granularity", F.lit(granularity)).select(*AGG_KEY, *columns)


def _no_aggregates(points: DataFrame) -> DataFrame:
    keys = ", ".join(f"{c} string" for c in LEVEL)
    numbers = ", ".join(f"{c} {'long' if c == 'count' else 'double'}" for c in STATS)
    return points.sparkSession.createDataFrame([], f"{keys}, ts timestamp_ntz, {numbers}")


def _placed_by_list(points: DataFrame, ends: list, width: int) -> tuple[DataFrame, DataFrame]:
    """Points with ``pane``, and windows with ``low`` and ``high`` pane, for a short list of ends.

    A pane is 2i on edge i of the sorted edges, and 2i - 1 between edges i - 1 and i.
    """
    last = np.array([(e - _EPOCH) // dt.timedelta(microseconds=1) for e in ends], np.int64)
    cuts = np.unique(np.concatenate((last, last - width)))

    @F.arrow_udf(T.LongType())
    def pane(us: pa.Array) -> pa.Array:
        times = us.to_numpy(zero_copy_only=False)
        at = np.searchsorted(cuts, times)
        on = cuts[np.minimum(at, len(cuts) - 1)] == times
        return pa.array(2 * at - ~on)

    low, high = (2 * np.searchsorted(cuts, edge) for edge in (last - width, last))
    rows = list(zip(ends, low.tolist(), high.tolist(), strict=True))
    windows = points.sparkSession.createDataFrame(rows, "window timestamp_ntz, low long, high long")
    inside = points.where(F.col("ts").between(*(from_micros(F.lit(int(x))) for x in cuts[[0, -1]])))
    return inside.withColumn("pane", pane(epoch_micros(F.col("ts")))), windows


def _placed_by_scan(points: DataFrame, ends: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The same for any number of ends, met by running counts in order of time."""
    last = epoch_micros(F.col("end_ts"))
    windows = ends.select(F.col("end_ts").alias("window"), last.alias("last"), (last - width).alias("first"))
    windows = stored(windows, "windows")
    edges = windows.select(F.explode(F.array("first", "last")).alias("us")).distinct()
    timed = points.withColumn("us", epoch_micros(F.col("ts")))
    marked = timed.select("us", F.lit(0).alias("edge")).union(edges.select("us", F.lit(1)))
    steps = marked.groupBy("us").agg(F.sum("edge").alias("edge")).withColumn("all", F.lit(0))
    ranked = stored(running_total(steps, ["all"], "us", "edge", "passed"), "edges")
    panes = ranked.select("us", (2 * F.col("passed") - F.col("edge") - 1).alias("pane"))
    number = 2 * (F.col("passed") - 1)
    low = ranked.where("edge > 0").select(F.col("us").alias("first"), number.alias("low"))
    high = ranked.where("edge > 0").select(F.col("us").alias("last"), number.alias("high"))
    windows = windows.join(low, "first").join(high, "last").select("window", "low", "high")
    return timed.join(panes, "us"), stored(windows, "windows")


def aggregate_trailing(points: DataFrame, granularity: str, ends: DataFrame) -> DataFrame:
    """Statistics over ``[end - granularity, end]``, both inclusive, for each ``end_ts``.

    The beginnings and ends of all windows cut time into panes, the edges themselves being
    panes of their own.  Every point is counted once, in its pane, and windows are put
    together from panes.  ``real_time`` has no window and gives no rows.
    """
    if granularity == "real_time":
        return _no_aggregates(points)
    width = GRANULARITY_SECONDS[granularity] * MICROS
    wanted = ends.where(F.col("end_ts").isNotNull()).select("end_ts").distinct()
    known = [r[0] for r in wanted.limit(SMALL_ROWS + 1).collect()]
    if not known:
        return _no_aggregates(points)
    if len(known) <= SMALL_ROWS:
        placed, windows = _placed_by_list(points, known, width)
    else:
        placed, windows = _placed_by_scan(points, wanted, width)
    placed = stored(placed.where(F.col("value").isNotNull()).select(*SERIES, "pane", "value"), "placed")
    cover = windows.select("window", F.explode(F.sequence("low", "high")).alias("pane"))
    counts = pane_counts(placed, SERIES, F.col("pane"))
    return (
        window_stats(counts, SERIES, cover, point_moments(placed, SERIES))
        .withColumnRenamed("window", "ts")
        .withColumn("granularity", F.lit(granularity))
        .select(*AGG_KEY, *STATS)
    )


def not_aggregated(points: DataFrame, aggregates: DataFrame, granularity: str) -> DataFrame:
    """Points whose time is not yet an aggregate time at the granularity."""
    done = aggregates.where(F.col("granularity") == granularity).select("ts").distinct()
    return points.join(done, "ts", "left_anti")


def upsert_aggregates(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Union in which a new row replaces the stored row with the same key."""
    both = stored.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)))
    return newest_rows(both, AGG_KEY, [F.desc("_load")]).drop("_load")


def metric_range(
    aggregates: DataFrame, name: str, type_: str, granularity: str, start: Column, end: Column
) -> DataFrame:
    """Aggregates of one series between two times (inclusive), oldest first."""
    return aggregates.where(
        (F.col("metric_name") == name)
        & (F.col("metric_type") == type_)
        & (F.col("granularity") == granularity)
        & F.col("ts").between(start, end)
    ).orderBy("ts")


def trend_of(current: Column, previous: Column) -> Column:
    """Ten percent up or down against the previous average, else stable."""
    return (
        F.when(current > previous * 1.1, "increasing")
        .when(current < previous * 0.9, "decreasing")
        .otherwise("stable")
    )


def trend(aggregates: DataFrame) -> DataFrame:
    """Latest average of each series against the one before it."""
    last_two = newest_rows(aggregates.select(*AGG_KEY, "avg"), LEVEL, [F.desc("ts")], 2)
    pairs = last_two.groupBy(*LEVEL).agg(
        F.max("ts").alias("ts"),
        F.max_by("avg", "ts").alias("current"),
        F.when(F.count(F.lit(1)) == 2, F.min_by("avg", "ts")).alias("previous"),
    )
    return pairs.withColumn("trend", trend_of(F.col("current"), F.col("previous")))


def trend_series(aggregates: DataFrame) -> DataFrame:
    """The same comparison for every aggregate row of a series."""
    rows = aggregates.select(*AGG_KEY, F.col("avg").alias("current"))
    compared = previous_value(rows, LEVEL, "ts", "current", "previous")
    return compared.withColumn("trend", trend_of(F.col("current"), F.col("previous")))


def latest_distribution(aggregates: DataFrame) -> DataFrame:
    """Distribution columns of the newest aggregate of each series and granularity."""
    newest = newest_rows(aggregates, LEVEL, [F.desc("ts")])
    return newest.select(*AGG_KEY, "min", "max", "avg", "std", *PERCENTILES)


def usage_success(aggregates: DataFrame) -> DataFrame:
    """Total, successful and success rate per series and granularity."""
    return (
        aggregates.groupBy(*LEVEL)
        .agg(F.sum("count").alias("total"), F.sum("sum").alias("successful"))
        .withColumn("success_rate", F.col("successful") / F.greatest("total", F.lit(1)))
    )


# Dashboard items: section, item, metric name, metric type, detail (fixed values).
OVERVIEW_ITEMS = [
    ("quality", "complexity", "cyclomatic_complexity", "quality", "distribution"),
    ("quality", "maintainability", "maintainability_index", "quality", "distribution"),
    ("quality", "security", "security_issues_count", "security", "distribution"),
    ("performance", "analysis_time", "analysis_time", "performance", "percentiles"),
    ("performance", "embedding_time", "embedding_generation_time", "performance", "percentiles"),
    ("testing", "success_rate", "test_success_rate", "testing", "distribution"),
    ("testing", "execution_time", "test_execution_time", "testing", "percentiles"),
]
USAGE_ITEMS = [
    ("usage", "commands_executed", "command_usage", "usage"),
    ("usage", "license_validations", "license_validation", "usage"),
]


def trend_period(as_of: Column, hours: int) -> Column:
    """Where the last ``hours`` before ``as_of`` begin."""
    return as_of - seconds_interval(hours * 3600)


def _period(aggregates: DataFrame, as_of: Column, hours: int) -> DataFrame:
    start = trend_period(as_of, hours)
    return aggregates.where(
        (F.col("granularity") == "minute") & F.col("ts").between(start, as_of)
    )


def _wanted(sections: Sequence[str]) -> list[str]:
    return sorted({i[2] for i in [*OVERVIEW_ITEMS, *USAGE_ITEMS] if i[0] in sections})


def overview(
    aggregates: DataFrame, as_of: Column, hours: int, sections: Sequence[str]
) -> DataFrame:
    """Current value, trend and distribution of the dashboard items, one row each.

    Items without data show 0 and ``stable``.  The item list is fixed, so the
    left join starts from a handful of rows.
    """
    rows = _period(aggregates, as_of, hours).where(F.col("metric_name").isin(_wanted(sections)))
    last_two = newest_rows(rows, SERIES, [F.desc("ts")], 2)
    newest = F.struct("avg", "min", "max", "std", *PERCENTILES)
    summary = last_two.groupBy(*SERIES).agg(
        F.max_by(newest, "ts").alias("_new"),
        F.when(F.count(F.lit(1)) == 2, F.min_by("avg", "ts")).alias("_previous"),
    )
    return _shown(summary, sections)


def _shown(summary: DataFrame, sections: Sequence[str]) -> DataFrame:
    items = summary.sparkSession.createDataFrame(
        [i for i in OVERVIEW_ITEMS if i[0] in sections],
        "section string, item string, metric_name string, metric_type string, detail string",
    )
    shown = items.join(summary, SERIES, "left")
    spread = F.col("detail") == "distribution"
    return shown.select(
        "section",
        "item",
        F.coalesce("_new.avg", F.lit(0.0)).alias("current"),
        trend_of(F.col("_new.avg"), F.col("_previous")).alias("trend"),
        *[F.when(spread, F.col(f"_new.{c}")).alias(c) for c in ("min", "max", "avg", "std")],
        *[F.col(f"_new.{c}").alias(c) for c in PERCENTILES],
    )


def _recent_minutes(
    points: DataFrame, as_of: Column, hours: int, sections: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Points of the dashboard's series in the period, and their minutes without percentiles.

    The time range reaches the scan: a minute counts when it starts in the period.
    """
    start = as_of - seconds_interval(hours * 3600)
    minute = seconds_interval(GRANULARITY_SECONDS["minute"])
    inside = points.where((F.col("ts") >= start) & (F.col("ts") < as_of + minute))
    inside = inside.where(F.col("metric_name").isin(_wanted(sections)))
    return inside, _period(aggregate_tumbling(inside, "minute", False), as_of, hours)


def _overview_of_minutes(
    inside: DataFrame, minutes: DataFrame, sections: Sequence[str]
) -> DataFrame:
    names = _wanted(sections)
    own = minutes.where(F.col("metric_name").isin(names))
    last_two = newest_rows(own, SERIES, [F.desc("ts")], 2)
    moments_of = F.struct("avg", "min", "max", "std")
    summary = last_two.groupBy(*SERIES).agg(
        F.max("ts").alias("_minute"),
        F.max_by(moments_of, "ts").alias("_new"),
        F.when(F.count(F.lit(1)) == 2, F.min_by("avg", "ts")).alias("_previous"),
    )
    # One row per series of the fixed item list.
    newest = F.broadcast(summary.select(*SERIES, F.col("_minute")))
    keyed = inside.where(F.col("value").isNotNull()).select(
        *SERIES, tumbling_start(F.col("ts"), "minute").alias("_minute"), "value"
    )
    last = keyed.join(newest, [*SERIES, "_minute"])
    found = exact_percentiles(frequency(last, SERIES), SERIES)
    fields = [F.col(f"_new.{c}").alias(c) for c in ("avg", "min", "max", "std")]
    summary = summary.join(F.broadcast(found), SERIES).select(
        *SERIES, F.struct(*fields, *PERCENTILES).alias("_new"), "_previous"
    )
    return _shown(summary, sections)


def overview_of_points(
    points: DataFrame, as_of: Column, hours: int, sections: Sequence[str]
) -> DataFrame:
    """The same items from raw points; only each series' newest minute gets percentiles."""
    inside, minutes = _recent_minutes(points, as_of, hours, sections)
    return _overview_of_minutes(inside, minutes, sections)


def usage_overview(aggregates: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Total, successful and success rate of commands and licence validations."""
    return usage_of_minutes(_period(aggregates, as_of, hours))


def usage_of_minutes(minutes: DataFrame) -> DataFrame:
    """The usage section from the minute aggregates of a period."""
    items = minutes.sparkSession.createDataFrame(
        USAGE_ITEMS, "section string, item string, metric_name string, metric_type string"
    )
    rows = minutes.where(F.col("metric_type") == "usage")
    return items.join(usage_success(rows), SERIES, "left").select(
        "section",
        "item",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("successful", F.lit(0.0)).alias("successful"),
        F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"),
    )


def metrics_report(aggregates: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """All four dashboard sections in one long table."""
    sections = ["quality", "performance", "testing"]
    return overview(aggregates, as_of, hours, sections).unionByName(
        usage_overview(aggregates, as_of, hours), allowMissingColumns=True
    )


def report_of_points(points: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """All four dashboard sections from raw points, read twice: for minutes and percentiles."""
    sections = ["quality", "performance", "testing"]
    inside, minutes = _recent_minutes(points, as_of, hours, [*sections, "usage"])
    return _overview_of_minutes(inside, minutes, sections).unionByName(
        usage_overview(minutes, as_of, hours), allowMissingColumns=True
    )


def recent_points(points: DataFrame, count: int = 20) -> DataFrame:
    """Last ``count`` points of each chart series; at equal times the larger values."""
    newest = newest_rows(points, ["metric_name"], [F.desc("ts"), F.desc("value")], count)
    return newest.select("metric_name", "ts", "value")


def request_rate(requests: DataFrame) -> DataFrame:
    """Total requests per endpoint and the per-second rate a chart shows (total / 60)."""
    return (
        requests.groupBy("endpoint")
        .agg(F.sum("total").alias("total"))
        .withColumn("rate", F.col("total") / 60)
    )
