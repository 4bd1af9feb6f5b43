"""Structured Streaming queries: the whole ``events`` table arrives as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import newest_rows
from ..operators import monitoring
from ..session import work_folder
from ..streaming import events as live
from ..streaming import windows
from .audit import RATE_SQL
from .fixtures import POINTS_SQL, TYPE_OF
from .monitoring import ALERTS_SQL, METRIC_OF, REQUESTS_SQL
from .registry import query, rounded, table
from .timeseries import FLOATS, ROUNDED_SQL, STATS_SQL, bucket_sql


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, a file or a folder, as a stream of several files by time."""
    events = table(spark, sf_dir, "events")
    folder = work_folder(spark, "replay")
    windows.replay(events, folder)
    return spark.readStream.schema(events.schema).parquet(folder)


def arriving_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in TYPE_OF.items() for x in pair])
    return arriving(spark, sf_dir).select(
        "ts",
        kind[F.col("event_type")].alias("metric_type"),
        F.col("event_type").alias("metric_name"),
        "value",
    )


def run_windows(
    spark: SparkSession, points: DataFrame, size: str, step: str | None, delay: str
) -> DataFrame:
    """Panes of the whole stream, then the statistics of all its windows."""
    folder = work_folder(spark, "panes")
    freq = windows.pane_frequency(points, size, step, delay)
    windows.run_available(windows.panes_writer(freq, folder, work_folder(spark, "progress")))
    panes = spark.read.schema(freq.schema).parquet(folder)
    return rounded(windows.stats_of_panes(panes, size, step), *FLOATS)


@query(
    "stream_tumbling",
    f"""WITH {POINTS_SQL}, stats AS (SELECT metric_name, metric_type, {bucket_sql('hour')} AS start,
  {bucket_sql('hour')} + INTERVAL 1 HOUR AS "end", {STATS_SQL} FROM points GROUP BY ALL)
SELECT metric_name, metric_type, start, "end", count, {ROUNDED_SQL} FROM stats""",
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_windows(spark, arriving_points(spark, sf_dir), "1 hour", None, "2 minutes")


@query(
    "stream_sliding",
    f"""WITH {POINTS_SQL}, placed AS (
  SELECT *, {bucket_sql('hour')} + INTERVAL 15 MINUTE * k AS start
  FROM points, (SELECT unnest(range(-3, 4)) AS k)),
stats AS (SELECT metric_name, metric_type, start, start + INTERVAL 1 HOUR AS "end", {STATS_SQL}
  FROM placed WHERE ts >= start AND ts < start + INTERVAL 1 HOUR GROUP BY ALL)
SELECT metric_name, metric_type, start, "end", count, {ROUNDED_SQL} FROM stats""",
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_windows(spark, arriving_points(spark, sf_dir), "1 hour", "15 minutes", "2 minutes")


@query("stream_alerts", f"WITH {ALERTS_SQL} SELECT * FROM alerts")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(*[F.lit(x) for pair in METRIC_OF.items() for x in pair])
    samples = arriving(spark, sf_dir).select(
        "ts", named[F.col("event_type")].alias("metric"), "value"
    )
    folder = work_folder(spark, "alerts")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    def broken(batch: DataFrame, number: int) -> None:
        raise ConnectionError("this channel is down")

    found = live.stream_alerts(samples, monitoring.alert_rules(spark))
    progress = work_folder(spark, "progress")
    windows.run_available(live.alert_writer(found, store, [broken], progress))
    return spark.read.parquet(folder).drop("batch")


@query(
    "stream_alerts_labelled",
    f"""WITH {REQUESTS_SQL}
SELECT 'high_error_rate' AS name, 'requests_total' AS metric, 'status=500' AS condition,
  'high' AS severity, 10.0::DOUBLE AS threshold, count(*) AS current_value
FROM requests WHERE status = '500' HAVING count(*) >= 10""",
)
def stream_alerts_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    counted = arriving(spark, sf_dir).where(F.col("event_id") != windows.CLOSING_ID).select(
        F.lit("requests_total").alias("metric"),
        F.create_map(F.lit("status"), status).alias("labels"),
        F.lit(1).alias("value"),
    )
    found = live.stream_alerts_labelled(counted, monitoring.alert_rules(spark))
    folder = work_folder(spark, "alerts")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    progress = work_folder(spark, "progress")
    writer = live.alert_writer(found, store, [], progress).outputMode("update")
    windows.run_available(writer)
    raised = spark.read.parquet(folder)
    return newest_rows(raised, ["name"], [F.desc("batch")]).drop("batch")


@query("stream_dedup", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = arriving(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    folder = work_folder(spark, "audit")
    unique = live.stream_dedup(twice)
    writer = unique.writeStream.format("parquet").option("path", folder)
    windows.run_available(writer.option("checkpointLocation", work_folder(spark, "progress")))
    stored = spark.read.schema(events.schema).parquet(folder)
    return stored.where(F.col("event_id") != windows.CLOSING_ID)


@query(
    "stream_rate_limit",
    RATE_SQL.format(width=12 * 3600 * 1_000_000),
)
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = arriving(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("identifier"),
        "ts",
        F.col("event_id").alias("attempt_id"),
    )
    folder = work_folder(spark, "decisions")
    decided = live.stream_rate_limit(attempts, window_seconds=12 * 3600)
    writer = decided.writeStream.format("parquet").option("path", folder)
    windows.run_available(writer.option("checkpointLocation", work_folder(spark, "progress")))
    stored = spark.read.schema(decided.schema).parquet(folder)
    return stored.select("identifier", "attempt_id", "allowed")
