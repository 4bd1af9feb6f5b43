"""Windowed statistics over arriving points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.panes import window_stats
from ..functions.stats import PERCENTILES, weighted_stats
from ..functions.times import MICROS, epoch_micros, event_time, from_event_time, from_micros

SERIES = ["metric_name", "metric_type"]
STATS = ["count", "sum", "avg", "min", "max", "std", *PERCENTILES]


def _micros(spark: SparkSession, length: str) -> int:
    """Microseconds of a length such as ``15 minutes``."""
    moved = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {length})")
    return moved.first()[0]


def pane_frequency(
    points: DataFrame, size: str, step: str | None = None, delay: str = "2 minutes"
) -> DataFrame:
    """Count of each distinct value per series and pane of arriving points.

    A pane has the greatest common length of ``size`` and ``step`` (none: ``size``), so every
    window is made of whole panes.  A point is counted once and state is one small row per
    value and open pane, whatever the ratio of the two lengths.  Rows that arrive when the
    watermark, ``delay`` behind, has passed their pane are dropped.
    """
    spark = points.sparkSession
    lengths = [_micros(spark, x) for x in (size, step or size)]
    window = F.window("_at", f"{math.gcd(*lengths)} microseconds")
    counted = (
        points.withColumn("_at", event_time(F.col("ts")))
        .withWatermark("_at", delay)
        .groupBy(window.alias("w"), *SERIES, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        from_event_time(F.col("w.start")).alias("start"),
        from_event_time(F.col("w.end")).alias("end"),
        *SERIES,
        "value",
        "n",
    )


def panes_writer(freq: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Write each pane's counts once the watermark closes it.

    A batch writes its own folder, so a repeated batch replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        freq.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )


def stats_of_panes(
    panes: DataFrame, size: str, step: str | None = None, upto: Column | None = None
) -> DataFrame:
    """Statistics of the windows of closed panes: ``start``, ``end`` and the usual columns.

    Windows begin at multiples of ``step``.  ``upto``, for a stream that goes on, leaves out
    windows that end later, because panes of theirs may still be open.  Windows that do not
    overlap are groups like any other.
    """
    spark = panes.sparkSession
    width = _micros(spark, size)
    shift = _micros(spark, step or size)
    begins, ends = epoch_micros(F.col("start")), epoch_micros(F.col("end"))
    counts = panes.where(F.col("value").isNotNull())
    counts = counts.select(*SERIES, begins.alias("pane"), ends.alias("pane_end"), "value", "n")
    window = F.floor(F.col("pane") / shift)
    closed = None if upto is None else F.col("window") * shift + width <= epoch_micros(upto)
    if width == shift:
        placed = counts.select(*SERIES, window.alias("window"), "value", "n")
        placed = placed if closed is None else placed.where(closed)
        found = weighted_stats(placed, [*SERIES, "window"])
    else:
        first = F.ceil((F.col("pane_end") - width) / shift)
        cover = counts.select("pane", "pane_end").distinct().select(
            "pane", F.explode(F.sequence(first, window)).alias("window")
        )
        cover = cover if closed is None else cover.where(closed)
        found = window_stats(counts.drop("pane_end"), SERIES, cover)
    start = F.col("window") * shift
    return found.select(
        *SERIES, from_micros(start).alias("start"), from_micros(start + width).alias("end"), *STATS
    )


# Ids and value of the row that ends a replay; no rule or window of the data holds them.
CLOSING_ID = -1
CLOSING_VALUE = -1.7e308


def replay(events: DataFrame, folder: str, pieces: int = 4, after_days: int = 400) -> None:
    """Write a finite table as a folder that a stream reads to its very end.

    The rows are cut into ``pieces`` files by time.  A last file holds one row, a copy of
    the newest event with id and user -1, a value no rule reaches and a time ``after_days``
    later: it moves the watermark past all events, so that no window stays open.  A table
    without times raises an error instead of giving an empty stream.
    """
    newest = events.where(F.col("ts").isNotNull()).orderBy(F.desc("ts")).limit(1)
    if not newest.count():
        raise ValueError("there are no events to replay")
    events.repartitionByRange(pieces, "ts").write.parquet(folder)
    closing = newest.withColumns(
        {
            "ts": F.col("ts") + F.make_dt_interval(days=F.lit(after_days)),
            "event_id": F.lit(CLOSING_ID).cast(events.schema["event_id"].dataType),
            "user_id": F.lit(CLOSING_ID).cast(events.schema["user_id"].dataType),
            "value": F.lit(CLOSING_VALUE),
        }
    )
    closing.select(*events.columns).write.mode("append").parquet(folder)


def run_available(writer: DataStreamWriter) -> None:
    """Process all data there is, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
