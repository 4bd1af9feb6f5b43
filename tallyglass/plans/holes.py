"""The same operators over events in which users, types and times are missing.

Of every seven events one has no user, one no type and one no time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import GRANULARITY_SECONDS, seconds_interval, tumbling_start
from ..operators import audit
from ..operators import timeseries as ts
from ..session import work_folder
from ..streaming import windows
from .fixtures import TYPE_OF, TYPE_SQL
from .registry import query, rounded, table
from .streams import run_windows
from .timeseries import FLOATS, KEY_SQL, ROUNDED_SQL, STATS_SQL, TREND_SQL, bucket_sql, tumbling_sql

HOLES_SQL = """holes AS (SELECT event_id, value,
  CASE WHEN event_id % 7 <> 1 THEN user_id END AS user_id,
  CASE WHEN event_id % 7 <> 3 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 <> 5 THEN ts END AS ts FROM events)"""
POINTS_SQL = f"""{HOLES_SQL}, points AS (
  SELECT ts, {TYPE_SQL} AS metric_type, event_type AS metric_name, value FROM holes WHERE ts IS NOT NULL)"""


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 7
    return table(spark, sf_dir, "events").withColumns(
        {
            "user_id": F.when(turn != 1, F.col("user_id")),
            "event_type": F.when(turn != 3, F.col("event_type")),
            "ts": F.when(turn != 5, F.col("ts")),
        }
    )


def as_points(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in TYPE_OF.items() for x in pair])
    return events.select(
        "ts",
        kind[F.col("event_type")].alias("metric_type"),
        F.col("event_type").alias("metric_name"),
        "value",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_points(holes(spark, sf_dir))


@query(
    "agg_tumbling_holes",
    f"WITH {POINTS_SQL}, {tumbling_sql('day')} SELECT {KEY_SQL}, count, {ROUNDED_SQL} FROM aggs",
)
def agg_tumbling_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.aggregate_tumbling(points(spark, sf_dir), "day"), *FLOATS)


_WEEK = GRANULARITY_SECONDS["week"]


@query(
    "agg_trailing_holes",
    f"""WITH {POINTS_SQL},
ends AS (SELECT DISTINCT {bucket_sql('day')} + INTERVAL 1 DAY AS end_ts FROM holes WHERE ts IS NOT NULL)
SELECT metric_name, metric_type, 'week' AS granularity, ts, count, {ROUNDED_SQL} FROM (
  SELECT metric_name, metric_type, end_ts AS ts, {STATS_SQL}
  FROM points JOIN ends ON points.ts BETWEEN end_ts - INTERVAL {_WEEK} SECOND AND end_ts
  GROUP BY metric_name, metric_type, end_ts)""",
)
def agg_trailing_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = points(spark, sf_dir)
    ends = some.select(
        (tumbling_start(F.col("ts"), "day") + seconds_interval(86_400)).alias("end_ts")
    )
    return rounded(ts.aggregate_trailing(some, "week", ends), *FLOATS)


@query(
    "trend_series_holes",
    f"""WITH {POINTS_SQL}, {tumbling_sql('day')}, series AS (
  SELECT metric_name, metric_type, granularity, ts, avg AS current,
    lag(avg) OVER (PARTITION BY metric_name, metric_type, granularity ORDER BY ts) AS previous FROM aggs)
SELECT {KEY_SQL}, round(current, 8) AS current, round(previous, 8) AS previous, {TREND_SQL} AS trend FROM series""",
)
def trend_series_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ts.aggregate_tumbling(points(spark, sf_dir), "day", False)
    return rounded(ts.trend_series(daily), "current", "previous")


@query(
    "lockout_holes",
    f"""WITH {HOLES_SQL} SELECT CAST(e.user_id AS VARCHAR) AS identifier, e.event_id, e.ts,
  count(f.ts) AS failures, count(f.ts) >= 5 AS blocked
FROM holes e LEFT JOIN (SELECT user_id, ts FROM holes WHERE event_type = 'error') f
  ON f.user_id IS NOT DISTINCT FROM e.user_id AND f.ts > e.ts - INTERVAL 3 DAY AND f.ts <= e.ts
GROUP BY ALL""",
)
def lockout_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = holes(spark, sf_dir)
    checks = every.select(F.col("user_id").cast("string").alias("identifier"), "event_id", "ts")
    failures = checks.join(every.where("event_type = 'error'").select("event_id"), "event_id")
    return audit.lockout(failures, checks, window_seconds=3 * 86_400)


@query(
    "failed_attempt_events_holes",
    f"""WITH {HOLES_SQL}, failed AS (SELECT * FROM holes WHERE event_type = 'error')
SELECT 'failed-' || event_id AS event_id, ts, 'security_violation' AS event_type,
  'warning' AS threat_level, '10.0.0.' || (event_id % 250) AS ip_address,
  'Failed attempt for ' || coalesce(CAST(user_id AS VARCHAR), 'nobody') AS description,
  '{{"attempts":' || (SELECT count(*) FROM failed g WHERE g.user_id IS NOT DISTINCT FROM failed.user_id
    AND g.ts > failed.ts - INTERVAL 3 DAY AND g.ts <= failed.ts) || '}}' AS metadata
FROM failed""",
)
def failed_attempt_events_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = holes(spark, sf_dir).where("event_type = 'error'").select(
        F.col("event_id").alias("attempt_id"),
        F.col("user_id").cast("string").alias("identifier"),
        "ts",
        F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string")).alias("ip_address"),
    )
    return audit.failed_attempt_events(failed, 3 * 86_400)


@query(
    "rate_limit_holes",
    f"""WITH RECURSIVE {HOLES_SQL}, numbered AS (
  SELECT user_id, event_id // 2 AS attempt, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id // 2) AS n
  FROM holes WHERE ts IS NOT NULL),
steps AS (
  SELECT user_id, attempt, n, [us] AS accepted, true AS allowed FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.user_id, x.attempt, x.n,
    CASE WHEN len([a FOR a IN s.accepted IF a > x.us - 43200000000]) < 5
      THEN list_append([a FOR a IN s.accepted IF a > x.us - 43200000000], x.us)
      ELSE [a FOR a IN s.accepted IF a > x.us - 43200000000] END,
    len([a FOR a IN s.accepted IF a > x.us - 43200000000]) < 5
  FROM steps s JOIN numbered x ON x.user_id IS NOT DISTINCT FROM s.user_id AND x.n = s.n + 1)
SELECT CAST(user_id AS VARCHAR) AS identifier, attempt AS attempt_id, allowed FROM steps
UNION ALL SELECT CAST(user_id AS VARCHAR), event_id // 2, false FROM holes WHERE ts IS NULL""",
)
def rate_limit_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt id stands twice, and a seventh of the attempts have no identifier."""
    attempts = holes(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("identifier"),
        "ts",
        F.floor(F.col("event_id") / 2).alias("attempt_id"),
    )
    decided = audit.rate_limit(attempts, window_seconds=12 * 3600)
    return decided.select("identifier", "attempt_id", "allowed")


@query(
    "stream_tumbling_holes",
    f"""WITH {POINTS_SQL}, stats AS (SELECT metric_name, metric_type, {bucket_sql('day')} AS start,
  {bucket_sql('day')} + INTERVAL 1 DAY AS "end", {STATS_SQL} FROM points GROUP BY ALL)
SELECT metric_name, metric_type, start, "end", count, {ROUNDED_SQL} FROM stats""",
)
def stream_tumbling_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = holes(spark, sf_dir)
    folder = work_folder(spark, "replay")
    windows.replay(events, folder)
    arriving = spark.readStream.schema(events.schema).parquet(folder)
    return run_windows(spark, as_points(arriving), "1 day", None, "2 minutes")
