"""Logs, instruments, alerts, health and profiles over ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitoring as m
from ..operators import profiles
from ..session import work_folder
from ..sources import sinks
from .fixtures import TYPE_SQL, metric_points
from .registry import at, query, rounded, table

START, END = "2024-01-02 00:00:00", "2024-01-30 12:00:00"
LOGS_SQL = """logs AS (SELECT ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  event_type || ' ' || props AS message, CAST(user_id AS VARCHAR) AS user_id, event_id FROM events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "ts",
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat_ws(" ", "event_type", "props").alias("message"),
        F.col("user_id").cast("string").alias("user_id"),
        "event_id",
    )


@query(
    "log_search",
    f"""WITH {LOGS_SQL} SELECT * FROM logs
WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND level = 'ERROR'
ORDER BY ts DESC, event_id DESC LIMIT 1000""",
)
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.log_search(logs(spark, sf_dir), at(START), at(END), "ERROR")


@query(
    "log_search_text",
    f"""WITH {LOGS_SQL} SELECT * FROM logs
WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND level = 'INFO'
  AND contains(lower(message), 'purchase')
ORDER BY ts DESC, event_id DESC LIMIT 100""",
)
def log_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.log_search(logs(spark, sf_dir), at(START), at(END), "info", "Purchase", 100)


@query(
    "metrics_append",
    f"""SELECT ts, {TYPE_SQL} AS metric_type, event_type AS metric_name, value, props AS metadata,
  '{{"user_id":"' || user_id || '"}}' AS tags FROM events""",
)
def metrics_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "metrics")
    sinks.metrics_append(metric_points(spark, sf_dir), folder)
    return sinks.metrics_read(spark, folder)


@query(
    "metrics_read_range",
    f"""SELECT ts, {TYPE_SQL} AS metric_type, event_type AS metric_name, value, props AS metadata,
  '{{"user_id":"' || user_id || '"}}' AS tags FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-07 12:00:00'""",
)
def metrics_read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the folders of three days are read."""
    folder = work_folder(spark, "metrics")
    sinks.metrics_append(metric_points(spark, sf_dir), folder)
    return sinks.metrics_read(spark, folder, at("2024-01-05 06:00:00"), at("2024-01-07 12:00:00"))


@query("log_append", f"WITH {LOGS_SQL} SELECT * FROM logs")
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "logs")
    rows = logs(spark, sf_dir)
    sinks.log_append(rows.where(F.col("level") == "ERROR"), folder)
    sinks.log_append(rows.union(rows), folder)
    return sinks.log_read(spark, folder, rows.schema)


REQUESTS_SQL = """requests AS (SELECT ts, event_id, 'requests_total' AS metric,
  CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, event_type AS endpoint,
  CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, value / 100 AS duration FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "ts",
        "event_id",
        F.lit("requests_total").alias("metric"),
        F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        F.lit(1).alias("value"),
        (F.col("value") / 100).alias("duration"),
    )


@query(
    "counters",
    f"""WITH {REQUESTS_SQL} SELECT metric, method, endpoint, status, count(*) AS total
FROM requests GROUP BY ALL""",
)
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.counters(requests(spark, sf_dir), ["method", "endpoint", "status"])


@query(
    "counters_analysis",
    """SELECT 'code_analysis_total' AS metric, event_type AS language,
  CASE WHEN value < 50 THEN 'success' ELSE 'error' END AS status, count(*) AS total
FROM events GROUP BY ALL""",
)
def counters_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyses = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("language"), (F.col("value") < 50).alias("success")
    )
    return m.analysis_counters(analyses)


BUCKETS_SQL = ", ".join([f"('{b:g}', {b!r}::DOUBLE)" for b in m.BOUNDS] + ["('+Inf', 'inf'::DOUBLE)"])


@query(
    "histograms",
    f"""WITH {REQUESTS_SQL}, total AS (
  SELECT method, endpoint, sum(duration) AS sum, count(*) AS count FROM requests GROUP BY ALL),
per AS (SELECT method, endpoint, le, count(*) FILTER (duration <= bound) AS bucket
  FROM requests, (VALUES {BUCKETS_SQL}) AS b(le, bound) GROUP BY ALL)
SELECT 'request_duration_seconds' AS metric, method, endpoint, le, bucket, round(sum, 6) AS sum, count
FROM per JOIN total USING (method, endpoint)""",
)
def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = requests(spark, sf_dir).select(
        F.lit("request_duration_seconds").alias("metric"),
        "method",
        "endpoint",
        F.col("duration").alias("value"),
    )
    return rounded(m.histograms(samples, ["method", "endpoint"]), "sum", digits=6)


# Metric of each event type (fixed values of the fixture).
METRIC_OF = {
    "click": "system_cpu_usage_percent",
    "error": "request_duration_seconds",
    "purchase": "system_disk_usage_percent",
    "signup": "active_users",
    "view": "system_memory_usage_percent",
}
METRIC_SQL = (
    "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_OF.items()) + " END"
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(*[F.lit(x) for pair in METRIC_OF.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", named[F.col("event_type")].alias("metric"), "user_id", "value"
    )


@query(
    "gauges",
    f"""SELECT {METRIC_SQL} AS metric, user_id, arg_max(value, ts) AS value
FROM events GROUP BY ALL""",
)
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.gauges(samples(spark, sf_dir), ["user_id"], "event_id")


@query(
    "metrics_summary",
    """SELECT arg_max(value, ts) FILTER (event_type = 'click') AS cpu_usage,
  arg_max(value, ts) FILTER (event_type = 'view') AS memory_usage,
  arg_max(value, ts) FILTER (event_type = 'purchase') AS disk_usage,
  arg_max(value, ts) FILTER (event_type = 'signup') AS active_users,
  count(*) AS requests_total FROM events""",
)
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.metrics_summary(samples(spark, sf_dir), requests(spark, sf_dir), "event_id")


CHECKS_SQL = """checks AS (
  SELECT event_id AS run_id, 'disk_space' AS "check", value >= 10 AS healthy,
    CASE WHEN value < 10 THEN printf('Low disk space: %.1f%% free', value) END AS detail FROM events
  UNION ALL SELECT event_id, 'memory', value * 2 <= 90,
    CASE WHEN value * 2 > 90 THEN printf('High memory usage: %.1f%%', value * 2) END FROM events)"""


def host_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("value").alias("disk_free_percent"),
        (F.col("value") * 2).alias("memory_percent"),
    )


# The one-decimal message text is left out of the comparison: printf and
# format_string round exact halves differently.
@query(
    "host_thresholds",
    f"""WITH {CHECKS_SQL} SELECT run_id, "check", healthy, detail IS NOT NULL AS failed FROM checks""",
)
def host_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = m.host_checks(host_samples(spark, sf_dir))
    return checks.select("run_id", "check", "healthy", F.col("detail").isNotNull().alias("failed"))


@query(
    "health_rollup",
    f"""WITH {CHECKS_SQL}, every AS (
  SELECT run_id, healthy FROM checks
  UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE true END FROM events)
SELECT run_id, CASE WHEN bool_and(coalesce(healthy, false)) THEN 'healthy' ELSE 'unhealthy' END AS overall_status,
  count(*) FILTER (NOT coalesce(healthy, false)) AS failed_checks FROM every GROUP BY run_id""",
)
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = m.host_checks(host_samples(spark, sf_dir)).select("run_id", "check", "healthy")
    own = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.lit("network").alias("check"),
        F.when(F.col("event_id") % 3 != 0, True).alias("healthy"),
    )
    return m.health_rollup(checks.unionByName(own))


RULES_SQL = ", ".join(
    f"('{n}', '{metric}', {threshold}::DOUBLE, '{severity}', '{text}')"
    for n, metric, condition, threshold, severity, text in m.ALERT_RULES
    if condition is None
)
ALERTS_SQL = f"""samples AS (SELECT ts, {METRIC_SQL} AS metric, value FROM events),
hits AS (
  SELECT name || '_' || (epoch_us(ts) // 1000000) AS alert_id, ts, severity, name AS title, description,
    metric AS source, metric AS metric_name, threshold, value AS current_value
  FROM samples JOIN (VALUES {RULES_SQL}) AS r(name, metric, threshold, severity, description) USING (metric)
  WHERE value >= threshold),
alerts AS (SELECT * FROM hits
  QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY ts, current_value) = 1)"""


def raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.alerts(samples(spark, sf_dir), m.alert_rules(spark))


@query("alerts", f"WITH {ALERTS_SQL} SELECT * FROM alerts")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(spark, sf_dir)


@query(
    "alerts_labelled",
    f"""WITH {REQUESTS_SQL}
SELECT 'high_error_rate' AS name, 'requests_total' AS metric, 'status=500' AS condition,
  'high' AS severity, 10.0::DOUBLE AS threshold, count(*) AS current_value
FROM requests WHERE status = '500' HAVING count(*) >= 10""",
)
def alerts_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(
        F.lit("method"), F.col("method"), F.lit("status"), F.col("status")
    ).alias("labels")
    counted = requests(spark, sf_dir).select("metric", labels, "value")
    return m.alerts_labelled(counted, m.alert_rules(spark))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of large values are resolved an hour later."""
    hour = F.make_dt_interval(hours=F.lit(1))
    big: Column = F.col("current_value") > 100
    return raised(spark, sf_dir).where(big).select("alert_id", (F.col("ts") + hour).alias("resolved_at"))


@query("alerts_active", f"WITH {ALERTS_SQL} SELECT * FROM alerts WHERE current_value <= 100")
def alerts_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.alerts_active(raised(spark, sf_dir), resolutions(spark, sf_dir))


@query(
    "alerts_all",
    f"""WITH {ALERTS_SQL} SELECT alert_id, current_value > 100 AS resolved,
  CASE WHEN current_value > 100 THEN ts + INTERVAL 1 HOUR END AS resolved_at FROM alerts""",
)
def alerts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = m.alerts_with_state(raised(spark, sf_dir), resolutions(spark, sf_dir))
    return states.select("alert_id", "resolved", "resolved_at")


PROFILES_SQL = """profiles AS (SELECT event_type AS operation, epoch_us(ts) / 1000000 AS end_time, ts,
  value AS duration, value / 3 AS memory_usage, event_id % 7 AS hits, event_id % 3 AS misses FROM events)"""
SUMMARY_SQL = """SELECT operation, count(*) AS count, round(avg(duration), 8) AS avg_duration,
  max(duration) AS max_duration, min(duration) AS min_duration, round(avg(memory_usage), 8) AS avg_memory,
  round(avg(hits / greatest(hits + misses, 1)), 8) AS avg_cache_hit_rate"""
AVERAGES = ["avg_duration", "avg_memory", "avg_cache_hit_rate"]


def run_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("operation"),
        F.col("ts").alias("end_time"),
        F.col("value").alias("duration"),
        (F.col("value") / 3).alias("memory_usage"),
        (F.col("event_id") % 7).alias("cache_hits"),
        (F.col("event_id") % 3).alias("cache_misses"),
    )


@query("profile_summary", f"WITH {PROFILES_SQL} {SUMMARY_SQL} FROM profiles GROUP BY operation")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.profile_summary(run_profiles(spark, sf_dir)), *AVERAGES)


@query(
    "profile_summary_latest",
    f"""WITH {PROFILES_SQL} {SUMMARY_SQL}
FROM (SELECT * FROM profiles ORDER BY ts DESC, operation, duration LIMIT 1000) GROUP BY operation""",
)
def profile_summary_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.profile_summary(run_profiles(spark, sf_dir), last=1000)
    return rounded(found, *AVERAGES)


@query(
    "cache_hit_rate",
    """SELECT event_type AS cache, count(*) FILTER (value < 20) AS hits,
  count(*) FILTER (value >= 20) AS misses, round(avg((value < 20)::INT), 8) AS hit_rate
FROM events GROUP BY event_type""",
)
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("cache"), (F.col("value") < 20).alias("hit")
    )
    return rounded(profiles.cache_hit_rate(log), "hit_rate")
