"""Streams in several batches: order of arrival, late rows, and the end of a replay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tallyglass.functions import panes, stats
from tallyglass.operators import monitoring
from tallyglass.streaming import events as live
from tallyglass.streaming import windows

START = dt.datetime(2024, 3, 1)
SECOND = dt.timedelta(seconds=1)


def arriving(spark, folder, batches, schema):
    """One file and one batch for each list of rows."""
    for rows in batches:
        frame = spark.createDataFrame(rows, schema).coalesce(1)
        frame.write.mode("append").parquet(folder)
    reader = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(folder)


def test_the_earliest_breach_of_a_second_is_kept(spark, tmp_path):
    rules = spark.createDataFrame([("hot", "cpu", None, 90.0, "high", "text")], monitoring.RULE_SCHEMA)
    at = lambda seconds: START + dt.timedelta(seconds=seconds)
    batches = [
        [("cpu", at(10.5), 95.0), ("cpu", at(11), 99.0), ("disk", at(10), 99.0)],
        [("cpu", at(10.25), 91.0), ("cpu", at(12), 10.0)],  # earlier, but arrives later
        [("cpu", at(500), 97.0)],
        [("cpu", at(501), 0.0)],  # lateness counts from the batch after
        [("cpu", at(10.1), 98.0)],  # too late
        [("cpu", at(5000), 0.0)],
    ]
    samples = arriving(spark, str(tmp_path / "in"), batches, "metric string, ts timestamp_ntz, value double")
    folder, seen = str(tmp_path / "out"), []

    def store(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    def channel(batch, number):
        seen.append(batch.count())
        raise ConnectionError("down")

    found = live.stream_alerts(samples, rules)
    windows.run_available(live.alert_writer(found, store, [channel], str(tmp_path / "progress")))
    rows = spark.read.parquet(folder).collect()
    assert sorted((r["ts"], r["current_value"]) for r in rows) == [
        (at(10.25), 91.0), (at(11), 99.0), (at(500), 97.0),
    ]
    assert sum(seen) == 3


def test_a_failed_store_fails_the_stream(spark, tmp_path):
    rules = monitoring.alert_rules(spark)
    metric, threshold = rules.where("condition IS NULL").select("metric", "threshold").first()
    rows = [(metric, START, threshold + 1.0), (metric, START + dt.timedelta(days=1), 0.0)]
    samples = arriving(spark, str(tmp_path / "in"), [rows], "metric string, ts timestamp_ntz, value double")

    def store(batch, number):
        raise OSError("disk full")

    writer = live.alert_writer(live.stream_alerts(samples, rules), store, [], str(tmp_path / "p"))
    with pytest.raises(Exception, match="disk full"):
        windows.run_available(writer)


def test_sliding_windows_over_several_batches(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    schema = "metric_name string, metric_type string, ts timestamp_ntz, value double"
    batches = [
        [("m", "t", START + minute, 1.0), ("m", "t", START + 5 * minute, None)],
        [("m", "t", START + 2 * minute, 3.0)],  # late, inside the delay
        [("m", "t", START + 40 * minute, 5.0)],
        [("m", "t", START + 41 * minute, None)],
        [("m", "t", START + 3 * minute, 9.0)],  # too late
        [("m", "t", START + 500 * minute, 0.0)],
    ]
    points = arriving(spark, str(tmp_path / "in"), batches, schema)
    freq = windows.pane_frequency(points, "20 minutes", "10 minutes", "10 minutes")
    folder = str(tmp_path / "out")
    windows.run_available(windows.panes_writer(freq, folder, str(tmp_path / "p")))
    panes = spark.read.parquet(folder)
    rows = windows.stats_of_panes(panes, "20 minutes", "10 minutes").collect()
    got = {r["start"]: (r["count"], r["sum"], r["p50"]) for r in rows}
    assert got == {
        START - 10 * minute: (2, 4.0, 2.0), START: (2, 4.0, 2.0),
        START + 30 * minute: (1, 5.0, 5.0), START + 40 * minute: (1, 5.0, 5.0),
    }
    # Every point once, whatever the windows: 1, 3, 5 and the two without a value.
    assert panes.agg(F.sum("n")).first()[0] == 5
    some = windows.stats_of_panes(panes, "20 minutes", "10 minutes", F.lit(START + 50 * minute))
    assert {r["start"] for r in some.collect()} == set(got) - {START + 40 * minute}


def test_windows_that_no_step_divides(spark):
    """Size 6 and step 4 minutes: panes of 2 minutes."""
    schema = "start timestamp_ntz, end timestamp_ntz, metric_name string, metric_type string, value double, n long"
    minute = dt.timedelta(minutes=1)
    epoch = dt.datetime(1970, 1, 1)
    rows = [(epoch + p * minute, epoch + (p + 2) * minute, "m", None, float(p), 1) for p in range(20, 40, 2)]
    found = windows.stats_of_panes(spark.createDataFrame(rows, schema), "6 minutes", "4 minutes")
    got = {(r["start"] - epoch) // minute: (r["end"] - r["start"], r["count"], r["sum"]) for r in found.collect()}
    expected = {}
    for w in range(0, 60, 4):
        inside = [p for p in range(20, 40, 2) if w <= p and p + 2 <= w + 6]
        if inside:
            expected[w] = (6 * minute, len(inside), float(sum(inside)))
    assert got == expected


def test_tumbling_windows_of_a_long_series_share_bounded_tasks(spark, monkeypatch):
    """Over 100,000 values in small windows: no bins over the whole series, parts that grow with the rows."""

    def whole_series(*args, **more):
        raise AssertionError("a small window needs no bins of its series")

    monkeypatch.setattr(panes, "window_percentiles", whole_series)
    monkeypatch.setattr(stats, "TASK_ROWS", 10_000, raising=False)
    hour = (F.col("id") / 500).cast("int")  # 240 windows of 500 values
    start = F.lit(START) + F.make_interval(hours=hour)
    rows = spark.range(120_000).select(
        start.alias("start"), (start + F.expr("interval 1 hour")).alias("end"), F.lit("m").alias("metric_name"),
        F.lit(None).cast("string").alias("metric_type"), F.col("id").cast("double").alias("value"),
        F.lit(2).cast("long").alias("n"),
    )
    found = windows.stats_of_panes(rows, "1 hour").withColumn("part", F.spark_partition_id()).collect()
    assert len(found) == 240 and len({r["part"] for r in found}) > 8
    for r in found:
        first = 500 * ((r["start"] - START) // dt.timedelta(hours=1))
        assert (r["count"], r["sum"], r["min"], r["max"]) == (1000, 1000 * (first + 249.5), first, first + 499)
        assert r["p50"] == first + 249.5 and r["p99"] == pytest.approx(first + 494.01)
        assert r["std"] == pytest.approx(((500**2 - 1) / 12) ** 0.5, rel=1e-12)


def test_replay_reads_folders_and_closes_all_windows(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    rows = [(n, START + n * SECOND, 1, "view", float(n)) for n in range(50)]
    events = spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "replay")
    windows.replay(events, folder, pieces=3)
    back = spark.read.parquet(folder)
    assert back.count() == 51 and back.where(F.col("event_id") == windows.CLOSING_ID).count() == 1
    with pytest.raises(ValueError):
        windows.replay(events.limit(0), str(tmp_path / "none"))
