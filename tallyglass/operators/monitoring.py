"""Logs, counters, histograms, gauges, health and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import small_side
from ..functions.times import MICROS, epoch_micros

# Upper bounds of duration buckets in seconds (fixed values; +Inf is added).
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

RULE_SCHEMA = (
    "name string, metric string, condition string, threshold double, severity string, "
    "description string"
)
# Default alert rules (fixed values).
ALERT_RULES = [
    (
        "high_cpu_usage",
        "system_cpu_usage_percent",
        None,
        80.0,
        "high",
        "CPU usage is above 80%",
    ),
    (
        "high_memory_usage",
        "system_memory_usage_percent",
        None,
        85.0,
        "high",
        "Memory usage is above 85%",
    ),
    (
        "high_disk_usage",
        "system_disk_usage_percent",
        None,
        90.0,
        "critical",
        "Disk usage is above 90%",
    ),
    ("high_error_rate", "requests_total", "status=500", 10.0, "high", "High error rate detected"),
    (
        "slow_response_time",
        "request_duration_seconds",
        None,
        5.0,
        "medium",
        "Response time is above 5 seconds",
    ),
]


def alert_rules(spark: SparkSession, extra: Sequence[tuple] = ()) -> DataFrame:
    """The default rules and any further ones."""
    return spark.createDataFrame([*ALERT_RULES, *extra], RULE_SCHEMA)


def log_search(
    logs: DataFrame,
    start: Column,
    end: Column,
    level: str | None = None,
    text: str | None = None,
    limit: int = 1000,
) -> DataFrame:
    """Newest logs in a time range, by level and case-insensitive text."""
    found = logs.where(F.col("ts").between(start, end))
    if level:
        found = found.where(F.col("level") == level.upper())
    if text:
        found = found.where(F.lower("message").contains(text.lower()))
    return found.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def counters(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Total by metric and label columns."""
    return samples.groupBy("metric", *labels).agg(F.sum("value").alias("total"))


def analysis_counters(analyses: DataFrame) -> DataFrame:
    """Analyses counted by language and outcome."""
    samples = analyses.select(
        F.lit("code_analysis_total").alias("metric"),
        "language",
        F.when(F.col("success"), "success").otherwise("error").alias("status"),
        F.lit(1).alias("value"),
    )
    return counters(samples, ["language", "status"])


def histograms(
    samples: DataFrame, labels: Sequence[str], bounds: Sequence[float] = BOUNDS
) -> DataFrame:
    """Cumulative buckets, sum and count of durations by label columns.

    All buckets of a group are columns of one partial aggregation.
    """
    value = F.col("value")
    buckets = [(f"{b:g}", F.count_if(value <= b)) for b in bounds]
    buckets.append(("+Inf", F.count(F.lit(1))))
    wide = samples.groupBy("metric", *labels).agg(
        *[count.alias(f"_le{i}") for i, (_, count) in enumerate(buckets)],
        F.sum("value").alias("sum"),
        F.count(F.lit(1)).alias("count"),
    )
    pairs = F.array(
        *[
            F.struct(F.lit(le).alias("le"), F.col(f"_le{i}").alias("n"))
            for i, (le, _) in enumerate(buckets)
        ]
    )
    long = wide.withColumn("_b", F.explode(pairs))
    return long.select("metric", *labels, "_b.le", F.col("_b.n").alias("bucket"), "sum", "count")


def gauges(samples: DataFrame, labels: Sequence[str], tie: str) -> DataFrame:
    """Last written value by metric and label columns; ``tie`` orders equal times."""
    return samples.groupBy("metric", *labels).agg(
        F.max_by("value", F.struct("ts", tie)).alias("value")
    )


def metrics_summary(samples: DataFrame, requests: DataFrame, tie: str) -> DataFrame:
    """Host gauges, total requests and active users in one row."""
    names = {
        "cpu_usage": "system_cpu_usage_percent",
        "memory_usage": "system_memory_usage_percent",
        "disk_usage": "system_disk_usage_percent",
        "active_users": "active_users",
    }
    last = gauges(samples.where(F.col("metric").isin(*names.values())), [], tie)
    row = last.agg(
        *[
            F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(c)
            for c, m in names.items()
        ]
    )
    total = requests.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("requests_total"))
    return row.withColumn("requests_total", total.scalar())


def host_checks(samples: DataFrame) -> DataFrame:
    """Disk and memory checks of host samples ``(run_id, disk_free_percent, memory_percent)``."""
    free, used = F.col("disk_free_percent"), F.col("memory_percent")
    low_disk, high_memory = free < 10, used > 90
    checks = F.array(
        F.struct(
            F.lit("disk_space").alias("check"),
            (~low_disk).alias("healthy"),
            F.when(low_disk, F.format_string("Low disk space: %.1f%% free", free)).alias("detail"),
        ),
        F.struct(
            F.lit("memory").alias("check"),
            (~high_memory).alias("healthy"),
            F.when(high_memory, F.format_string("High memory usage: %.1f%%", used)).alias("detail"),
        ),
    )
    return samples.select("run_id", F.explode(checks).alias("c")).select("run_id", "c.*")


def health_rollup(checks: DataFrame) -> DataFrame:
    """Overall status per run: unhealthy if any check fails or lacks its flag."""
    healthy = F.coalesce("healthy", F.lit(False))
    return checks.groupBy("run_id").agg(
        F.when(F.bool_and(healthy), "healthy").otherwise("unhealthy").alias("overall_status"),
        F.count_if(~healthy).alias("failed_checks"),
    )


ALERT = [
    "alert_id",
    "ts",
    "severity",
    "title",
    "description",
    "source",
    "metric_name",
    "threshold",
    "current_value",
]


def breaches(samples: DataFrame, rules: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One alert row per sample and rule it breaks, before removing repeats.

    The samples never move: rules go to every task if a count shows them to be few.
    """
    second = F.floor(epoch_micros(F.col("ts")) / MICROS).cast("string")
    plain = small_side(rules.where(F.col("condition").isNull()))
    hit = samples.select("metric", "ts", "value", *keep).join(plain, "metric")
    return hit.where(F.col("value") >= F.col("threshold")).select(
        F.concat("name", F.lit("_"), second).alias("alert_id"),
        "ts",
        "severity",
        F.col("name").alias("title"),
        "description",
        F.col("metric").alias("source"),
        F.col("metric").alias("metric_name"),
        "threshold",
        F.col("value").alias("current_value"),
        *keep,
    )


def alerts(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """First breach of each rule and second; the rule and second make the id."""
    first = F.min_by(F.struct(*ALERT[1:]), F.struct("ts", "current_value"))
    found = breaches(samples, rules).groupBy("alert_id").agg(first.alias("_a"))
    return found.select("alert_id", "_a.*")


def alerts_labelled(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with a ``label=value`` condition against the counter of that label.

    ``samples`` has a ``labels`` map; values are summed per rule before the test.  On a
    stream the sum runs on, so a rule fires once its counter has reached the threshold.
    """
    parts = F.split("condition", "=", 2)
    labelled = rules.where(F.col("condition").isNotNull()).select(
        "*", parts[0].alias("_label"), parts[1].alias("_wanted")
    )
    counted = samples.select("metric", "labels", "value").join(small_side(labelled), "metric")
    counted = counted.where(F.try_element_at("labels", F.col("_label")) == F.col("_wanted"))
    totals = counted.groupBy("name", "metric", "condition", "severity", "threshold").agg(
        F.sum("value").alias("current_value")
    )
    return totals.where(F.col("current_value") >= F.col("threshold"))


def alerts_with_state(raised: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Alerts with their resolution time ``(alert_id, resolved_at)``."""
    ended = resolutions.groupBy("alert_id").agg(F.max("resolved_at").alias("resolved_at"))
    return raised.join(ended, "alert_id", "left").withColumn(
        "resolved", F.col("resolved_at").isNotNull()
    )


def alerts_active(raised: DataFrame, resolutions: DataFrame) -> DataFrame:
    return raised.join(resolutions.select("alert_id"), "alert_id", "left_anti")
