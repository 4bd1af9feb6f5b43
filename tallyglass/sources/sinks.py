"""Tables written and read back: graph state, reports, points and logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..operators.timeseries import upsert_aggregates
from ..session import stored as merged_version


def graph_save(folder: str, **tables: DataFrame) -> None:
    """Write the tables of a graph, code and metrics included."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def graph_load(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}")


def report_sink(
    folder: str, summary: DataFrame, sections: DataFrame, advice: DataFrame, lines: DataFrame
) -> None:
    """The report as JSON tables and as one ordered Markdown text."""
    parts = {"summary": summary, "sections": sections, "recommendations": advice}
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    ordered = lines.orderBy("block", "node_id", "position").select("line")
    ordered.write.mode("overwrite").text(f"{folder}/markdown")


def _as_json(column: str):
    """JSON text of a map, null when it is empty."""
    return F.when(F.size(column) > 0, F.to_json(column))


def metrics_append(points: DataFrame, folder: str) -> None:
    """Append points; one folder per metric type and day, tags as JSON."""
    stored = points.withColumn("tags", _as_json("tags")).withColumn("date", F.to_date("ts"))
    stored.write.mode("append").partitionBy("metric_type", "date").parquet(folder)


def metrics_read(
    spark: SparkSession, folder: str, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Stored points, between two times (inclusive) if given; only their days are read."""
    schema = (
        "ts timestamp_ntz, metric_name string, value double, metadata string, tags string, "
        "metric_type string, date date"
    )
    points = spark.read.schema(schema).parquet(folder)
    if start is not None:
        points = points.where((F.col("date") >= F.to_date(start)) & (F.col("ts") >= start))
    if end is not None:
        points = points.where((F.col("date") <= F.to_date(end)) & (F.col("ts") <= end))
    return points.drop("date")


def _stored(spark: SparkSession, folder: str, schema: StructType) -> DataFrame | None:
    """The table in a folder, or nothing if the folder does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _of_same(stored: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Stored rows in the folders (``columns``) of the new rows; null is a folder too."""
    folders = new.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return stored.join(F.broadcast(folders), same, "left_semi")  # at most a row a day


def log_append(events: DataFrame, folder: str, key: str = "event_id") -> DataFrame:
    """Append events whose id is neither stored nor repeated within the batch.

    An id is required: events without one are not stored and are returned.

    One folder per day, and one for rows without a time; an id belongs to one time, so only
    the days of the batch are searched for stored ids.
    """
    named = events.where(F.col(key).isNotNull())
    dated = named.dropDuplicates([key]).withColumn("date", F.to_date("ts"))
    stored = _stored(events.sparkSession, folder, dated.schema)
    if stored is not None:
        known = _of_same(stored.select("date", key), dated, ["date"])
        dated = dated.join(known.select(key), key, "left_anti")
    dated.write.mode("append").partitionBy("date").parquet(folder)
    return events.where(F.col(key).isNull())


def log_read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    dated = StructType([*schema.fields, StructField("date", DateType())])
    return spark.read.schema(dated).parquet(folder).drop("date")


def aggregates_write(aggregates: DataFrame, folder: str) -> None:
    """Merge aggregates into the stored ones: a row replaces the one with its key.

    Days the aggregates touch are merged into a new version, which is written in full
    before it takes their place; other days and other series of those days stay.  Rows
    without a time are merged alike.
    """
    dated = aggregates.withColumn("date", F.to_date("ts"))
    stored = _stored(aggregates.sparkSession, folder, dated.schema)
    if stored is not None:
        same_days = _of_same(stored, dated, ["granularity", "date"])
        dated = merged_version(upsert_aggregates(same_days, dated), "aggregates")
    (
        dated.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("granularity", "date")
        .parquet(folder)
    )


def aggregates_read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    dated = StructType([*schema.fields, StructField("date", DateType())])
    return spark.read.schema(dated).parquet(folder).drop("date")
