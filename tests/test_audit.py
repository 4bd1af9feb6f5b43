"""Rate limits, lockouts and sessions against small plain models; batch equals stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tallyglass.operators import audit
from tallyglass.streaming.events import stream_dedup, stream_rate_limit
from tallyglass.streaming.windows import pane_frequency, panes_writer, run_available, stats_of_panes

START = dt.datetime(2024, 5, 1)


def attempts_of(spark, rows):
    return spark.createDataFrame(rows, "identifier string, ts timestamp_ntz, attempt_id long")


def plain_limit(rows, limit, window):
    accepted, allowed = {}, {}
    for name, ts, number in sorted(rows, key=lambda r: (r[1], r[2])):
        recent = [t for t in accepted.get(name, []) if t > ts - window]
        allowed[number] = len(recent) < limit
        accepted[name] = recent + [ts] if allowed[number] else recent
    return allowed


def random_attempts(seed, count=600):
    rng = random.Random(seed)
    rows = []
    for number in range(count):
        # one identifier makes a third of all attempts, many at the same second
        name = "hot" if rng.random() < 0.34 else f"u{rng.randrange(20)}"
        seconds = rng.choice([rng.randrange(600), rng.randrange(20_000)])
        rows.append((name, START + dt.timedelta(seconds=seconds), number))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_rate_limit_matches_a_plain_model(spark, seed):
    rows = random_attempts(seed)
    # exactly one window later an attempt passes again
    rows += [("edge", START + dt.timedelta(seconds=i), 9000 + i) for i in range(6)]
    rows += [("edge", START + dt.timedelta(minutes=15), 9100)]
    found = audit.rate_limit(attempts_of(spark, rows)).collect()
    got = {r.attempt_id: r.allowed for r in found}
    assert got == plain_limit(rows, 5, dt.timedelta(minutes=15))
    assert got[9100] and not got[9005]


def plain_by_row(rows, limit, window):
    """Allowed or not for each row, repeated and nameless ones included."""
    accepted, out = {}, [False] * len(rows)
    timed = [i for i, r in enumerate(rows) if r[1] is not None]
    for i in sorted(timed, key=lambda i: (rows[i][1], rows[i][2])):
        name, ts, _ = rows[i]
        recent = [t for t in accepted.get(name, []) if t > ts - window]
        out[i] = len(recent) < limit
        accepted[name] = recent + [ts] if out[i] else recent
    return sorted((str(r[0]), str(r[1]), r[2], a) for r, a in zip(rows, out, strict=True))


@pytest.mark.parametrize("parts, at_once", [(1, 4), (6, 4), (25, 2), (25, 1)])
@pytest.mark.parametrize("kind", ["dense", "bursts", "mixed"])
def test_rate_limit_over_many_parts(spark, monkeypatch, parts, at_once, kind):
    """A dense identifier never falls into step again; bursts with pauses soon do."""
    monkeypatch.setattr(audit, "PARTS_AT_ONCE", at_once)
    rng = random.Random(parts + at_once)
    second = dt.timedelta(seconds=1)
    rows = [(f"u{rng.randrange(40)}", START + second * rng.randrange(40_000), n) for n in range(300)]
    if kind != "bursts":
        rows += [("hot", START + 7 * second * n, 1000 + n) for n in range(900)]
    if kind != "dense":
        rows += [("burst", START + second * (2000 * (n // 12) + n % 12), 3000 + n) for n in range(500)]
        rows += [(None, START + second * rng.randrange(9000), 5000 + n) for n in range(300)]
    rows += [("hot", START + 70 * second, 1010)] * 8 + [("late", None, 1), (None, None, 1), ("null", START, 3)]
    df = attempts_of(spark, rows).withColumn("tags", F.create_map(F.lit("a"), F.lit("b")))
    found = audit.rate_limit(df, parts=parts)
    assert found.columns == [*df.columns, "allowed"]
    got = sorted((str(r.identifier), str(r.ts), r.attempt_id, r.allowed) for r in found.collect())
    assert got == plain_by_row(rows, 5, dt.timedelta(minutes=15))
    assert audit.rate_limit(df.limit(0), parts=parts).count() == 0


def test_lockout_counts_strictly_within_the_window(spark):
    half = dt.timedelta(minutes=30)
    failures = [("a", START + dt.timedelta(minutes=i)) for i in range(5)] + [("b", START)]
    checks = [
        ("a", START + dt.timedelta(minutes=4)),
        ("a", START + half - dt.timedelta(microseconds=1)),
        ("a", START + half),
        ("b", START),
        ("c", START),
    ]
    result = audit.lockout(
        spark.createDataFrame(failures, "identifier string, ts timestamp_ntz"),
        spark.createDataFrame(checks, "identifier string, ts timestamp_ntz"),
    )
    got = {(r.identifier, r.ts): (r.failures, r.blocked) for r in result.collect()}
    assert [got[c] for c in checks] == [
        (5, True),
        (5, True),
        (4, False),
        (1, False),
        (0, False),
    ]


def test_lockout_keeps_checks_without_identifier_or_time(spark):
    minute = dt.timedelta(minutes=1)
    rows = [(None, START, 1), (None, START + minute, 2), ("a", None, 3), (None, None, 4), ("a", START, 5)]
    rows += [(None, START + minute, 2)]  # a repeated row
    df = attempts_of(spark, rows).withColumn("ip_address", F.lit("ip"))
    found = sorted((r.attempt_id, r.failures) for r in audit.lockout(df, df).collect())
    assert found == [(1, 1), (2, 3), (2, 3), (3, 0), (4, 0), (5, 1)]
    events = sorted((r.event_id, r.metadata) for r in audit.failed_attempt_events(df).collect())
    assert len(events) == 6 and events[0] == ("failed-1", '{"attempts":1}')
    assert audit.lockout(df.limit(0), df.limit(0)).count() == 0


def test_lockout_matches_a_plain_model(spark):
    rows = random_attempts(7, 300)
    df = attempts_of(spark, rows)
    failures = df.where(F.col("attempt_id") % 2 == 0)
    found = audit.lockout(failures, df).collect()
    window = dt.timedelta(minutes=30)
    for r in found:
        expected = sum(
            1
            for name, ts, number in rows
            if number % 2 == 0 and name == r.identifier and r.ts - window < ts <= r.ts
        )
        assert r.failures == expected
    assert len(found) == len(rows)


def test_sessions_first_match_wins(spark):
    day = dt.timedelta(hours=24)
    sessions = spark.createDataFrame(
        [(1, "u", "ip", START)],
        "session_id long, user_id string, ip_address string, created_at timestamp_ntz",
    )
    requests = spark.createDataFrame(
        [
            (1, 1, "ip", START + day),
            (2, 1, "ip", START + day + dt.timedelta(microseconds=1)),
            (3, 1, "other", START + 2 * day),
            (4, 2, "ip", START),
        ],
        "request_id long, session_id long, ip_address string, ts timestamp_ntz",
    )
    validity = audit.session_validity(requests, sessions)
    got = {r.request_id: r.status for r in validity.collect()}
    assert got == {1: "valid", 2: "expired", 3: "ip_mismatch", 4: "unknown"}
    assert [r.event_id for r in audit.session_violations(validity).collect()] == ["violation-3"]


def stream_of(spark, df, folder, files=4):
    """The rows as a stream of several files in time order, one per batch."""
    rows = df.collect()
    rows.sort(key=lambda r: r.ts)
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(str(folder))


def test_stream_rate_limit_equals_batch(spark, tmp_path):
    rows = random_attempts(3, 400)
    # a far later attempt lets the watermark pass all others
    rows.append(("late", START + dt.timedelta(days=2), 5000))
    df = attempts_of(spark, rows)
    decided = stream_rate_limit(stream_of(spark, df, tmp_path / "in"))
    out = str(tmp_path / "out")
    writer = decided.writeStream.format("parquet").option("path", out)
    run_available(writer.option("checkpointLocation", str(tmp_path / "progress")))
    got = {r.attempt_id: r.allowed for r in spark.read.parquet(out).collect()}
    expected = plain_limit(rows, 5, dt.timedelta(minutes=15))
    del expected[5000]
    assert got == expected


def test_stream_statistics_equal_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [
        (rng.choice("ab"), "t", START + dt.timedelta(seconds=rng.randrange(7200)), float(i % 7))
        for i in range(500)
    ] + [("z", "t", START + dt.timedelta(days=1), 1.0)]
    df = spark.createDataFrame(
        rows, "metric_name string, metric_type string, ts timestamp_ntz, value double"
    )
    freq = pane_frequency(stream_of(spark, df, tmp_path / "in"), "10 minutes")
    out = str(tmp_path / "out")
    run_available(panes_writer(freq, out, str(tmp_path / "progress")))
    got = {
        (r.metric_name, r.start): (r["count"], round(r["sum"], 6), round(r["p90"], 6))
        for r in stats_of_panes(spark.read.parquet(out), "10 minutes").collect()
    }
    ten = F.window("ts", "10 minutes").start
    batch = df.where("metric_name <> 'z'").groupBy("metric_name", ten.alias("start")).agg(
        F.count("*"), F.sum("value"), F.percentile("value", F.lit(0.9))
    )
    expected = {(r[0], r[1]): (r[2], round(r[3], 6), round(r[4], 6)) for r in batch.collect()}
    assert got == expected


def test_stream_dedup_keeps_each_id_once(spark, tmp_path):
    rows = [(i % 50, START + dt.timedelta(seconds=i % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz")
    unique = stream_dedup(stream_of(spark, df, tmp_path / "in"))
    out = str(tmp_path / "out")
    writer = unique.writeStream.format("parquet").option("path", out)
    run_available(writer.option("checkpointLocation", str(tmp_path / "progress")))
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(50))


def test_stream_dedup_keeps_rows_without_an_id(spark, tmp_path):
    rows = [(None if i % 2 else i % 10, START + dt.timedelta(seconds=i % 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz")
    writer = stream_dedup(stream_of(spark, df, tmp_path / "in")).writeStream.format("parquet")
    out = str(tmp_path / "out")
    run_available(writer.option("path", out).option("checkpointLocation", str(tmp_path / "progress")))
    got = sorted((r.event_id is None, r.event_id or 0) for r in spark.read.parquet(out).collect())
    assert got == [(False, i) for i in range(0, 10, 2)] + [(True, 0)] * 20
