"""Statistics, trends and windows against small plain models."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyglass.functions import panes, scans, skew
from tallyglass.functions.stats import (
    exact_percentiles,
    frequency,
    grouped_stats,
    weighted_stats,
)
from tallyglass.functions.times import epoch_micros, from_micros, tumbling_start
from tallyglass.operators import timeseries as ts

START = dt.datetime(2024, 3, 1)


@pytest.mark.parametrize("parts, direct", [(1, 0), (7, 0), (200, 0), (7, 300), (7, 100_000)])
@pytest.mark.parametrize("weighted", [False, True])
def test_stats_match_numpy(spark, weighted, parts, direct):
    rng = random.Random(4)
    groups = {
        None: [rng.gauss(3, 1) for _ in range(90)],
        "same": [7.25] * 50,
        "one": [-3.5],
        "two": [1.0, 2.0],
        "mixed": [rng.uniform(-1e6, 1e6) for _ in range(700)] + [0.0, -0.0, 1e-300, -1e-300],
        "narrow": [1e9 + rng.random() for _ in range(300)],
        "narrower": [1.7e9 + n / 1e6 for n in range(500)] + [1e12, -1e12],
        # a third of all values are one value
        "hot": [5.0] * 400 + [rng.gauss(0, 1) for _ in range(800)],
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    rows += [(g, None) for g in groups for _ in range(40)]  # nulls count nowhere
    rng.shuffle(rows)
    points = spark.createDataFrame(rows, "g string, value double")
    if weighted:
        stats = weighted_stats(frequency(points, ["g"]), ["g"], parts=parts, direct=direct)
    else:
        stats = grouped_stats(points, ["g"], parts=parts, direct=direct)
    found = {r.g: r for r in stats.collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        row, a = found[g], np.array(values)
        assert row["count"] == len(a)
        assert row["min"] == a.min() and row["max"] == a.max()
        assert row["sum"] == pytest.approx(a.sum(), rel=1e-12, abs=1e-9)
        assert row["avg"] == pytest.approx(a.mean(), rel=1e-12, abs=1e-12)
        assert row["std"] == pytest.approx(a.std(), rel=1e-7, abs=1e-12)
        for p in (50, 90, 95, 99):
            expected = np.percentile(a, p)
            assert row[f"p{p}"] == pytest.approx(expected, rel=1e-12, abs=1e-12)


def test_close_values_lie_in_many_parts(spark):
    """A group of values close together is dealt out like any other."""
    freq = spark.range(50_000).select(
        F.lit("g").alias("g"), (F.col("id") / 1e6 + 1.7e9).alias("value"), F.lit(1).alias("n")
    )
    row = exact_percentiles(freq, ["g"], parts=20).first()
    assert row["p50"] == pytest.approx(1.7e9 + 24_999.5e-6, abs=1e-6)
    rows = scans.dealt(freq, ["g"], ["value"], parts=20)
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * 50_000 / 20


def test_buckets_without_values_have_no_row(spark):
    rows = [("m", "t", START, None), ("m", "t", START + dt.timedelta(hours=1), 1.0)]
    for percentiles in (True, False):
        found = ts.aggregate_tumbling(points_of(spark, rows), "hour", percentiles).collect()
        assert [(r["ts"], r["count"]) for r in found] == [(START + dt.timedelta(hours=1), 1)]


def points_of(spark, rows):
    return spark.createDataFrame(
        rows, "metric_name string, metric_type string, ts timestamp_ntz, value double"
    )


def test_trailing_is_inclusive_at_both_ends(spark):
    minute = dt.timedelta(minutes=1)
    tick = dt.timedelta(microseconds=1)
    rows = [
        ("m", "t", START - tick, 1.0),
        ("m", "t", START, 2.0),
        ("m", "t", START + minute, 3.0),
        ("m", "t", START + minute + tick, 4.0),
    ]
    ends = spark.createDataFrame([(START + minute,)], "end_ts timestamp_ntz")
    row = ts.aggregate_trailing(points_of(spark, rows), "minute", ends).collect()
    assert [(r["count"], r["sum"]) for r in row] == [(2, 5.0)]
    assert ts.aggregate_trailing(points_of(spark, rows), "real_time", ends).count() == 0


@pytest.mark.parametrize("short", [True, False])
def test_trailing_matches_a_plain_model(spark, monkeypatch, short):
    if not short:
        monkeypatch.setattr(ts, "SMALL_ROWS", 0)
    rng = random.Random(5)
    names = ["a", "b", None]
    rows = [
        (rng.choice(names), "t", START + dt.timedelta(seconds=rng.randrange(86_400)), rng.random())
        for _ in range(400)
    ]
    ends = [START + dt.timedelta(minutes=rng.randrange(1440)) for _ in range(20)]
    found = ts.aggregate_trailing(
        points_of(spark, rows),
        "hour",
        spark.createDataFrame([(e,) for e in ends], "end_ts timestamp_ntz"),
    )
    got = {(r.metric_name, r.ts): (r["count"], round(r.p90, 9)) for r in found.collect()}
    expected = {}
    for end in ends:
        for name in names:
            inside = [
                v for n, _, t, v in rows if n == name and end - dt.timedelta(hours=1) <= t <= end
            ]
            if inside:
                expected[name, end] = (len(inside), round(float(np.percentile(inside, 90)), 9))
    assert got == expected


@pytest.mark.parametrize("bins, direct", [(1, 0), (4, 0), (256, 0), (4, 100), (4, 100_000)])
def test_windows_of_panes_match_numpy(spark, bins, direct):
    """Overlapping windows, close values, equal values, null keys."""
    rng = random.Random(bins)
    rows = []
    for pane in range(30):
        rows += [("close", None, pane, 1.7e9 + rng.randrange(400) / 1000) for _ in range(15)]
        rows += [(None, "t", pane, rng.gauss(0, 5)) for _ in range(rng.randrange(9))]
        rows += [("same", "t", pane, 4.5)] * (pane % 3) + [("same", "t", pane, None)]
    points = spark.createDataFrame(rows, "metric_name string, metric_type string, pane long, value double")
    cover = [(w, p) for w in range(0, 40, 4) for p in range(w, w + 11)]
    found = panes.window_stats(
        panes.pane_counts(points, ts.SERIES, F.col("pane")),
        ts.SERIES,
        spark.createDataFrame(cover, "window long, pane long"),
        bins=bins,
        parts=5,
        direct=direct,
    )
    got = {(r.metric_name, r.metric_type, r.window): r for r in found.collect()}
    expected = {}
    for w, p in cover:
        for name, kind, pane, v in rows:
            if pane == p and v is not None:
                expected.setdefault((name, kind, w), []).append(v)
    assert set(got) == set(expected)
    for key, values in expected.items():
        r, a = got[key], np.array(values)
        assert (r["count"], r["min"], r["max"]) == (len(a), a.min(), a.max())
        assert r["avg"] == pytest.approx(a.mean(), rel=1e-12, abs=1e-12)
        assert r["std"] == pytest.approx(a.std(), rel=1e-6, abs=1e-9)
        for p in (50, 90, 95, 99):
            assert r[f"p{p}"] == pytest.approx(np.percentile(a, p), rel=1e-12, abs=1e-12)


def test_merged_panes_are_the_panes_of_merged_time(spark):
    rows = [("a", n % 40, float(n % 7)) for n in range(200)]
    points = spark.createDataFrame(rows, "k string, minute long, value double")
    fine = panes.pane_counts(points, ["k"], F.col("minute"))
    coarse = panes.merged_panes(fine, ["k"], F.floor(F.col("pane") / 10))
    direct = panes.pane_counts(points, ["k"], F.floor(F.col("minute") / 10))
    assert sorted(map(tuple, coarse.collect())) == sorted(map(tuple, direct.collect()))


def test_trend_rules(spark):
    def rows(name, *values):
        return [
            (name, "t", "hour", START + dt.timedelta(hours=i), v) for i, v in enumerate(values)
        ]

    data = rows("up", 1.0, 10.0, 11.1) + rows("down", 10.0, 8.9) + rows("flat", 10.0, 11.0)
    data += rows("single", 4.0)
    aggs = spark.createDataFrame(
        data,
        "metric_name string, metric_type string, granularity string, ts timestamp_ntz, avg double",
    )
    latest = {r.metric_name: r.trend for r in ts.trend(aggs).collect()}
    assert latest == {
        "up": "increasing",
        "down": "decreasing",
        "flat": "stable",
        "single": "stable",
    }
    assert ts.trend_series(aggs).where("trend = 'increasing'").count() == 2


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_scans_match_plain_windows(spark, parts):
    """Keys over many parts, null keys and orders, null values."""
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "b", None]), "x", i * rng.randrange(1, 9), rng.randrange(5)) for i in range(300)]
    rows += [("a", None, None, 3), ("only", "x", 1, 2), (None, None, 7, None)]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "k string, j string, o long, v long")
    total = scans.running_total(df, ["k", "j"], "o", "v", "total", parts)
    before = scans.previous_value(total, ["k", "j"], "o", "v", "before", parts)
    assert before.columns == ["k", "j", "o", "v", "total", "before"]
    got = {(r.k, r.j, r.o): (r.total, r.before) for r in before.collect()}
    assert len(got) == len(rows)
    for key in {r[:2] for r in rows}:
        running, previous = None, None
        for k, j, o, v in sorted((r for r in rows if r[:2] == key), key=lambda r: (r[2] is not None, r[2] or 0)):
            running = running if v is None else v + (running or 0)
            assert got[k, j, o] == (running, previous)
            previous = v


def test_values_at_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None]), v, rng.randrange(1, 4)) for v in rng.sample(range(999), 200)]
    freq = spark.createDataFrame(rows, "k string, v long, n long")
    wanted = {"low": F.lit(0), "mid": F.floor(F.col("_count") / 2), "high": F.col("_count") - 1}
    found = {r.k: r for r in scans.values_at_ranks(freq, ["k"], "v", "n", wanted, 9).collect()}
    for key in ("a", None):
        values = sorted(v for k, v, n in rows if k == key for _ in range(n))
        r = found[key]
        assert (r.low, r.mid, r.high) == (values[0], values[len(values) // 2], values[-1])


def test_salted_join_with_maps_and_many_null_keys(spark):
    rows = [(None if i % 3 else i % 7, {"i": str(i)}, [{"j": i}]) for i in range(600)]
    left = spark.createDataFrame(rows, "k long, tags map<string,string>, more array<map<string,long>>")
    right = spark.createDataFrame([(k, -k) for k in range(5)], "k long, b long")
    for how, count in (("inner", sum(r[0] is not None and r[0] < 5 for r in rows)), ("left", 600)):
        assert skew.lookup_join(left, right, ["k"], how, most=0).count() == count
    anti = skew.lookup_join(left, right, ["k"], "left_anti", most=0)
    assert anti.count() == sum(r[0] is None or r[0] >= 5 for r in rows)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame(
        [(1 if i % 3 else i, i) for i in range(500)] + [(None, -1)], "k long, a long"
    )
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 300)], "k long, b long")
    plain = left.join(right, "k", how)
    expected = sorted(map(str, plain.collect()))
    for joined in (
        skew.salted_join(left, right, ["k"], how),
        skew.lookup_join(left, right, ["k"], how),
        skew.lookup_join(left, right, ["k"], how, most=10),
    ):
        assert sorted(map(str, joined.select(*plain.columns).collect())) == expected


def test_times_do_not_depend_on_the_zone(spark):
    moments = [
        dt.datetime(1969, 12, 31, 23, 59, 59, 999_999),
        dt.datetime(2024, 3, 31, 2, 30, 0, 1),
        dt.datetime(2024, 10, 27, 2, 30),
        dt.datetime(9999, 12, 31, 23, 59, 59, 999_999),
    ]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        us = epoch_micros(F.col("t"))
        rows = df.select("t", us.alias("us"), from_micros(us).alias("back")).collect()
        hours = df.select(tumbling_start(F.col("t"), "hour").alias("h")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    epoch = dt.datetime(1970, 1, 1)
    for row in rows:
        assert row.us == (row.t - epoch) // dt.timedelta(microseconds=1)
        assert row.back == row.t
    assert [h.h for h in hours] == [m.replace(minute=0, second=0, microsecond=0) for m in moments]
