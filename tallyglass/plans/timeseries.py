"""Queries over metric points and their aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import GRANULARITY_SECONDS, seconds_interval, tumbling_start
from ..operators import timeseries as ts
from ..session import work_folder
from ..sources import sinks
from .fixtures import POINTS_SQL, RECORDED_SQL, metric_points, recorded_points
from .registry import at, query, rounded, table

AS_OF = "2024-02-01 00:00:00"
HOURS = 24 * 31
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
FLOATS = ["sum", "avg", "min", "max", "std", "p50", "p90", "p95", "p99"]

STATS_SQL = """count(*) AS count, sum(value) AS sum, avg(value) AS avg, min(value) AS min,
  max(value) AS max, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS p50,
  quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95,
  quantile_cont(value, 0.99) AS p99"""
DIGITS = {"sum": 6}
ROUNDED_SQL = ", ".join(f"round({c}, {DIGITS.get(c, 8)}) AS {c}" for c in FLOATS)


def bucket_sql(granularity: str, column: str = "ts") -> str:
    width = GRANULARITY_SECONDS[granularity] * 1_000_000
    return f"make_timestamp(epoch_us({column}) - epoch_us({column}) % {width})"


def tumbling_sql(granularity: str, source: str = "points", name: str = "aggs") -> str:
    return f"""{name} AS (
  SELECT metric_name, metric_type, '{granularity}' AS granularity,
    {bucket_sql(granularity)} AS ts, {STATS_SQL}
  FROM {source} GROUP BY ALL)"""


HOURLY = f"WITH {POINTS_SQL}, {tumbling_sql('hour')}"
DAILY = f"WITH {POINTS_SQL}, {tumbling_sql('day')}"
MIXED = f"""WITH {POINTS_SQL}, {tumbling_sql('hour', name='hours')}, {tumbling_sql('day', name='days')},
aggs AS (SELECT * FROM hours UNION ALL SELECT * FROM days)"""
KEY_SQL = "metric_name, metric_type, granularity, ts"
MINUTES = f"WITH {RECORDED_SQL}, {tumbling_sql('minute', 'recorded')}"


def hourly(spark: SparkSession, sf_dir: str, percentiles: bool = True) -> DataFrame:
    return ts.aggregate_tumbling(metric_points(spark, sf_dir), "hour", percentiles)


def mixed(spark: SparkSession, sf_dir: str, percentiles: bool = True) -> DataFrame:
    """Hourly and daily aggregates in one table."""
    points = metric_points(spark, sf_dir)
    return ts.aggregate_tumbling(points, "hour", percentiles).unionByName(
        ts.aggregate_tumbling(points, "day", percentiles)
    )


def by_minute(spark: SparkSession, sf_dir: str, percentiles: bool = True) -> DataFrame:
    return ts.aggregate_tumbling(recorded_points(spark, sf_dir), "minute", percentiles)


def _register_tumbling(granularity: str) -> None:
    name = "agg_tumbling" if granularity == "hour" else f"agg_tumbling_{granularity}"
    sql = f"WITH {POINTS_SQL}, {tumbling_sql(granularity)} SELECT {KEY_SQL}, count, {ROUNDED_SQL} FROM aggs"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(ts.aggregate_tumbling(metric_points(spark, sf_dir), granularity), *FLOATS)


for _granularity in GRANULARITY_SECONDS:
    _register_tumbling(_granularity)


# Every fourth value missing, and values close together far from zero.
NULLS_SQL = """points AS (SELECT ts, metric_type, metric_name,
  CASE WHEN user_id % 4 <> 0 THEN value END AS value FROM all_points)"""
CLOSE_SQL = """points AS (SELECT ts, metric_type, metric_name, 1.7e9::DOUBLE + value AS value
  FROM all_points)"""


def _register_values(name: str, source_sql: str, value: Callable[[], Column]) -> None:
    all_sql = POINTS_SQL.replace("points AS", "all_points AS")
    shown = [c for c in FLOATS if c not in ("sum", "avg", "std")]
    sql = f"""WITH {all_sql}, {source_sql}, {tumbling_sql('day')}
SELECT {KEY_SQL}, count, {", ".join(f"round({c}, 5) AS {c}" for c in shown)}
FROM aggs WHERE count > 0"""
    sql = sql.replace("count(*) AS count", "count(value) AS count")

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = metric_points(spark, sf_dir).withColumn("user_id", F.col("tags.user_id").cast("long"))
        found = ts.aggregate_tumbling(points.withColumn("value", value()), "day")
        # Sums of large numbers depend on their order in the last digits.
        return rounded(found.drop("sum", "avg", "std"), *shown, digits=5)


_register_values(
    "agg_tumbling_nulls", NULLS_SQL, lambda: F.when(F.col("user_id") % 4 != 0, F.col("value"))
)
_register_values("agg_tumbling_close", CLOSE_SQL, lambda: F.lit(1.7e9) + F.col("value"))


def _register_sums(name: str, source_sql: str, value: Callable[[], Column], shown: list[str]) -> None:
    """What depends on the order of sums too, rounded to the digits that no order changes."""
    all_sql = POINTS_SQL.replace("points AS", "all_points AS")
    sql = f"""WITH {all_sql}, {source_sql}, {tumbling_sql('day')}
SELECT {KEY_SQL}, count, {", ".join(shown)} FROM aggs WHERE count > 0"""
    sql = sql.replace("count(*) AS count", "count(value) AS count")

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = metric_points(spark, sf_dir).withColumn("user_id", F.col("tags.user_id").cast("long"))
        found = ts.aggregate_tumbling(points.withColumn("value", value()), "day")
        return found.selectExpr(*ts.AGG_KEY, "count", *shown)


_register_sums(
    "agg_tumbling_nulls_sums",
    NULLS_SQL,
    lambda: F.when(F.col("user_id") % 4 != 0, F.col("value")),
    ["round(sum, 6) AS sum", "round(avg, 8) AS avg", "round(std, 8) AS std"],
)
_register_sums(
    "agg_tumbling_close_sums",
    CLOSE_SQL,
    lambda: F.lit(1.7e9) + F.col("value"),
    [
        "round(sum / 1.7e9, 6) AS sum",
        "round(avg - 1.7e9, 1) AS avg",
        "round(std, 3) AS std",
    ],
)


def _register_trailing(granularity: str) -> None:
    name = "agg_trailing" if granularity == "week" else f"agg_trailing_{granularity}"
    width = GRANULARITY_SECONDS[granularity]
    sql = f"""WITH {POINTS_SQL},
ends AS (SELECT DISTINCT {bucket_sql('day')} + INTERVAL 1 DAY AS end_ts FROM events)
SELECT metric_name, metric_type, '{granularity}' AS granularity, ts, count, {ROUNDED_SQL} FROM (
  SELECT metric_name, metric_type, end_ts AS ts, {STATS_SQL}
  FROM points JOIN ends ON points.ts BETWEEN end_ts - INTERVAL {width} SECOND AND end_ts
  GROUP BY metric_name, metric_type, end_ts)"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = metric_points(spark, sf_dir)
        day_ends = points.select(
            (tumbling_start(F.col("ts"), "day") + seconds_interval(86_400)).alias("end_ts")
        )
        return rounded(ts.aggregate_trailing(points, granularity, day_ends), *FLOATS)


for _granularity in ("hour", "day", "week", "month"):
    _register_trailing(_granularity)


@query(
    "raw_not_aggregated",
    f"""WITH {POINTS_SQL},
done AS (SELECT DISTINCT ts FROM events WHERE value > 20)
SELECT ts, metric_type, metric_name, value FROM points
WHERE ts NOT IN (SELECT ts FROM done)""",
)
def raw_not_aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metric_points(spark, sf_dir).select("ts", "metric_type", "metric_name", "value")
    stamped = points.where(F.col("value") > 20).withColumn("granularity", F.lit("minute"))
    return ts.not_aggregated(points, stamped, "minute")


@query(
    "upsert_aggs",
    f"""{DAILY}, fresh AS (
  SELECT metric_name, metric_type, 'day' AS granularity, {bucket_sql('day')} AS ts,
    count(*) AS count, sum(value * 2) AS sum
  FROM points WHERE metric_type <> 'quality' GROUP BY ALL),
stored AS (SELECT {KEY_SQL}, count, sum FROM aggs WHERE metric_type <> 'usage')
SELECT {KEY_SQL}, count, round(sum, 6) AS sum FROM fresh
UNION ALL
SELECT {KEY_SQL}, count, round(sum, 6) AS sum FROM stored
WHERE ({KEY_SQL}) NOT IN (SELECT ({KEY_SQL}) FROM fresh)""",
)
def upsert_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metric_points(spark, sf_dir)
    stored = ts.aggregate_tumbling(points.where(F.col("metric_type") != "usage"), "day", False)
    doubled = points.where(F.col("metric_type") != "quality").withColumn(
        "value", F.col("value") * 2
    )
    fresh = ts.aggregate_tumbling(doubled, "day", False)
    folder = work_folder(spark, "aggregates")
    for part in (stored, fresh):
        # Each in two runs, so that runs meet in the same days.
        for type_is_usage in (True, False):
            some = part.where((F.col("metric_type") == "usage") == type_is_usage)
            sinks.aggregates_write(some, folder)
    merged = sinks.aggregates_read(spark, folder, stored.schema)
    return rounded(merged.select(*ts.AGG_KEY, "count", "sum"), "sum", digits=6)


@query(
    "metric_range",
    f"""{HOURLY} SELECT {KEY_SQL}, count, {ROUNDED_SQL} FROM aggs
WHERE metric_name = 'click' AND metric_type = 'usage' AND granularity = 'hour'
  AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""",
)
def metric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ts.metric_range(
        hourly(spark, sf_dir),
        "click",
        "usage",
        "hour",
        at("2024-01-05 00:00:00"),
        at("2024-01-20 12:00:00"),
    )
    return rounded(found, *FLOATS)


TREND_SQL = """CASE WHEN current > previous * 1.1 THEN 'increasing'
  WHEN current < previous * 0.9 THEN 'decreasing' ELSE 'stable' END"""
SERIES_SQL = """series AS (SELECT metric_name, metric_type, granularity, ts, avg AS current,
  lag(avg) OVER (PARTITION BY metric_name, metric_type, granularity ORDER BY ts) AS previous
  FROM aggs)"""


@query(
    "trend",
    f"""{MIXED}, {SERIES_SQL}
SELECT metric_name, metric_type, granularity, ts, round(current, 8) AS current,
  round(previous, 8) AS previous, {TREND_SQL} AS trend
FROM series QUALIFY row_number() OVER (
  PARTITION BY metric_name, metric_type, granularity ORDER BY ts DESC) = 1""",
)
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.trend(mixed(spark, sf_dir, False)), "current", "previous")


@query(
    "trend_series",
    f"""{MIXED}, {SERIES_SQL}
SELECT metric_name, metric_type, granularity, ts, round(current, 8) AS current,
  round(previous, 8) AS previous, {TREND_SQL} AS trend FROM series""",
)
def trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.trend_series(mixed(spark, sf_dir, False)), "current", "previous")


DISTRIBUTION = [c for c in FLOATS if c != "sum"]


@query(
    "latest_distribution",
    f"""{MIXED} SELECT {KEY_SQL},
  {", ".join(f"round({c}, 8) AS {c}" for c in DISTRIBUTION)}
FROM aggs QUALIFY row_number() OVER (
  PARTITION BY metric_name, metric_type, granularity ORDER BY ts DESC) = 1""",
)
def latest_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.latest_distribution(mixed(spark, sf_dir)), *DISTRIBUTION)


@query(
    "usage_success",
    f"""WITH {RECORDED_SQL}
SELECT metric_name, metric_type, granularity, count(*) AS total, sum(value) AS successful,
  round(sum(value) / greatest(count(*), 1), 8) AS success_rate
FROM recorded, (VALUES ('hour'), ('day')) AS levels(granularity)
WHERE metric_type = 'usage' GROUP BY metric_name, metric_type, granularity""",
)
def usage_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = recorded_points(spark, sf_dir).where(F.col("metric_type") == "usage")
    levels = [ts.aggregate_tumbling(usage, level, False) for level in ("hour", "day")]
    return rounded(ts.usage_success(levels[0].unionByName(levels[1])), "success_rate")


@query(
    "metrics_unpivot",
    f"""WITH {RECORDED_SQL}
SELECT ts, metric_type, metric_name, round(value, 8) AS value,
  CASE WHEN metric_name <> 'command_usage' THEN metadata END AS metadata,
  CASE WHEN metric_name = 'command_usage' THEN metadata ->> 'command' END AS command,
  CASE WHEN metric_name = 'command_usage' THEN metadata ->> 'success' END AS success,
  tag, tag_value FROM recorded""",
)
def metrics_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column; the number inside the command's JSON is left to its own two fields."""
    points = recorded_points(spark, sf_dir)
    of_command = F.col("metric_name") == "command_usage"
    shown = points.select(
        "ts",
        "metric_type",
        "metric_name",
        "value",
        F.when(~of_command, F.col("metadata")).alias("metadata"),
        F.when(of_command, F.get_json_object("metadata", "$.command")).alias("command"),
        F.when(of_command, F.get_json_object("metadata", "$.success")).alias("success"),
        F.map_keys("tags")[0].alias("tag"),
        F.map_values("tags")[0].alias("tag_value"),
    )
    return rounded(shown, "value")


def overview_sql(sections: list[str]) -> str:
    items = ", ".join(
        str(i) for i in ts.OVERVIEW_ITEMS if i[0] in sections
    )
    spread = ", ".join(
        f"CASE WHEN detail = 'distribution' THEN round({c}, 8) END AS {c}"
        for c in ("min", "max", "avg", "std")
    )
    points = ", ".join(f"round({c}, 8) AS {c}" for c in ("p50", "p90", "p95", "p99"))
    return f"""SELECT section, item, round(coalesce(avg, 0), 8) AS current,
  CASE WHEN avg > previous * 1.1 THEN 'increasing' WHEN avg < previous * 0.9 THEN 'decreasing'
    ELSE 'stable' END AS trend, {spread}, {points}
FROM (VALUES {items}) AS items(section, item, metric_name, metric_type, detail)
LEFT JOIN (
  SELECT *, lag(avg) OVER (PARTITION BY metric_name, metric_type ORDER BY ts) AS previous
  FROM aggs WHERE ts BETWEEN {AS_OF_SQL} - INTERVAL {HOURS} HOUR AND {AS_OF_SQL}
  QUALIFY row_number() OVER (PARTITION BY metric_name, metric_type ORDER BY ts DESC) = 1) latest
USING (metric_name, metric_type)"""


SHOWN = ["current", "min", "max", "avg", "std", "p50", "p90", "p95", "p99"]


def _register_overview(section: str) -> None:
    @query(f"overview_{section}", f"{MINUTES} {overview_sql([section])}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = recorded_points(spark, sf_dir)
        return rounded(ts.overview_of_points(points, at(AS_OF), HOURS, [section]), *SHOWN)


for _section in ("quality", "performance", "testing"):
    _register_overview(_section)

USAGE_SQL = f"""SELECT 'usage' AS section,
  CASE metric_name WHEN 'command_usage' THEN 'commands_executed' ELSE 'license_validations' END AS item,
  CAST(sum(count) AS BIGINT) AS total, sum(sum) AS successful,
  round(sum(sum) / greatest(sum(count), 1), 8) AS success_rate
FROM aggs WHERE metric_type = 'usage'
  AND ts BETWEEN {AS_OF_SQL} - INTERVAL {HOURS} HOUR AND {AS_OF_SQL} GROUP BY metric_name"""


@query("overview_usage", f"{MINUTES} {USAGE_SQL}")
def overview_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        ts.usage_overview(by_minute(spark, sf_dir, False), at(AS_OF), HOURS), "success_rate"
    )


@query(
    "metrics_report",
    f"""{MINUTES}, shown AS ({overview_sql(["quality", "performance", "testing"])}),
used AS ({USAGE_SQL})
SELECT * FROM shown UNION ALL BY NAME SELECT * FROM used""",
)
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = recorded_points(spark, sf_dir)
    return rounded(ts.report_of_points(points, at(AS_OF), HOURS), *SHOWN, "success_rate")


@query(
    "metrics_report_stored",
    f"""{MINUTES}, shown AS ({overview_sql(["quality", "performance", "testing"])}),
used AS ({USAGE_SQL})
SELECT * FROM shown UNION ALL BY NAME SELECT * FROM used""",
)
def metrics_report_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report from a stored table of all aggregates."""
    found = ts.metrics_report(by_minute(spark, sf_dir), at(AS_OF), HOURS)
    return rounded(found, *SHOWN, "success_rate")


@query(
    "recent_points",
    """SELECT event_type AS metric_name, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) <= 20""",
)
def recent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.recent_points(metric_points(spark, sf_dir))


@query(
    "request_rate",
    """SELECT event_type AS endpoint, count(*) AS total, round(count(*) / 60, 8) AS rate
FROM events GROUP BY event_type""",
)
def request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("endpoint"), F.lit(1).alias("total")
    )
    return rounded(ts.request_rate(requests), "rate")
