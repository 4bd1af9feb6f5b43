"""Sources, sinks, privacy, licences, billing, monitoring and similarity."""

import datetime as dt
import hashlib
import hmac
import zipfile
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from tallyglass.functions import skew
from tallyglass.functions.text import hmac_sha256, token_counts
from tallyglass.operators import audit, billing, licenses, monitoring, privacy, recorders, similarity
from tallyglass.operators import timeseries as ts
from tallyglass.plans import similarity as plan
from tallyglass.session import stored, work_folder
from tallyglass.sources import files, sinks

START = dt.datetime(2024, 5, 1)
AT = "2024-05-01 00:00:00"


def ntz(text=AT):
    return F.lit(text).cast("timestamp_ntz")


def test_source_scan_reads_every_python_file(spark, tmp_path):
    (tmp_path / "pkg" / "deep").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    content = {
        "setup.py": "x = 1",
        "pkg/__init__.py": "",
        "pkg/deep/a b.py": "é = 2",
        ".hidden/c.py": "c = 3",
    }
    for name, text in content.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "notes.txt").write_text("no code")
    (tmp_path / "pkg" / "latin.py").write_bytes(b"# \xe9")
    got = {r.path: r.content for r in files.source_scan(spark, str(tmp_path)).collect()}
    expected = {str(tmp_path / n): c for n, c in content.items()}
    expected[str(tmp_path / "pkg" / "latin.py")] = None
    assert got == expected
    by_uri = files.source_scan(spark, tmp_path.as_uri())
    assert by_uri.count() == len(expected)


def test_archive_scan(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "_project.zip", "w") as archive:
        archive.writestr("src/a.py", "a = 1")
        archive.writestr("../evil.py", "b = 2")
        archive.writestr("readme.md", "text")
    got = {r.path: r.content for r in files.archive_scan(spark, str(tmp_path)).collect()}
    base = str(tmp_path / "_project.zip")
    assert got == {f"{base}/src/a.py": "a = 1", f"{base}/../evil.py": "b = 2"}
    assert not (tmp_path / "evil.py").exists()


def test_unreadable_files_and_archives_are_rows(spark, tmp_path):
    """A broken archive, a broken member, a folder without access and a deep tree."""
    deep = tmp_path
    for n in range(12):
        deep = deep / f"d{n}"
    deep.mkdir(parents=True)
    (deep / "deep.py").write_text("x = 1")
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere.py")
    (tmp_path / "broken.zip").write_bytes(b"PK no archive " * 100)
    (tmp_path / "short.zip").write_bytes(b"PK")
    with zipfile.ZipFile(tmp_path / "some.zip", "w", zipfile.ZIP_STORED) as archive:
        for n in range(300):
            archive.writestr(f"m{n}.py", f"value = {n}")
        archive.writestr("bad.py", "tampered = 1")
    data = (tmp_path / "some.zip").read_bytes()
    (tmp_path / "some.zip").write_bytes(data.replace(b"tampered = 1", b"tampered = 2"))
    found = {r.path.removeprefix(f"{tmp_path}/"): r for r in files.source_scan(spark, str(tmp_path)).collect()}
    assert found["/".join(f"d{n}" for n in range(12)) + "/deep.py"].content == "x = 1"
    assert all(r.content is None and r.error for p, r in found.items() if p == "gone.py")
    members = {r.path.removeprefix(f"{tmp_path}/"): r for r in files.archive_scan(spark, str(tmp_path)).collect()}
    assert members["broken.zip"].content is None and "BadZipFile" in members["broken.zip"].error
    assert members["some.zip/bad.py"].content is None and "CRC" in members["some.zip/bad.py"].error
    assert all(members[f"some.zip/m{n}.py"].content == f"value = {n}" for n in range(300))
    assert members["short.zip"].content is None and members["short.zip"].error
    assert len(members) == 303
    missing = files.source_scan(spark, str(tmp_path / "absent")).collect()
    assert [(r.content, bool(r.error)) for r in missing] == [(None, True)]


def test_vectors_may_be_null_or_of_other_widths(spark):
    schema = "id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0, 0.0]), (4, [1.0, None]), (5, [0.0, 0.0]), (6, [2.0, 0.1])]
    vectors = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([(7, [3.0, 0.0]), (8, None), (9, [0.0, 0.0, 2.0])], schema.replace("id", "query_id", 1))
    text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
    for found in (
        similarity.similar_code(vectors, queries, 0.5),
        similarity._by_blocks(text(vectors, "id"), text(queries, "query_id"), 0.5, None),
    ):
        assert sorted((r.query_id, r.id) for r in found.collect()) == [("7", "1"), ("7", "6")]
    best = similarity.similar_code(vectors, queries, -1.0, top=1).collect()
    assert [(r.query_id, r.id) for r in best if r.query_id == "7"] == [("7", "1")]
    assert similarity.similar_code(vectors, queries.limit(0), 0.5).count() == 0


def test_required_ids_are_rejected(spark, tmp_path):
    rows = [("a", START), (None, START), (None, START)]
    events = spark.createDataFrame(rows, "event_id string, ts timestamp_ntz")
    for _ in range(2):
        assert sinks.log_append(events, str(tmp_path / "log")).count() == 2
    assert sinks.log_read(spark, str(tmp_path / "log"), events.schema).count() == 1
    person = "email string, name string, company string, phone string"
    incoming = spark.createDataFrame([("e", "n", "c", "p"), (None, "m", "c", "p")], person)
    known = "customer_id string, email string, name string, company string, phone string, "
    existing = spark.createDataFrame([], known + "created_at timestamp_ntz, updated_at timestamp_ntz")
    once = billing.customer_upsert(existing, incoming, ntz())
    assert once.count() == billing.customer_upsert(once, incoming, ntz()).count() == 1
    assert billing.nameless_customers(incoming).count() == 1


def test_log_append_is_unique_across_and_within_batches(spark, tmp_path):
    folder = str(tmp_path / "log")
    schema = "event_id string, ts timestamp_ntz"
    day = dt.timedelta(days=1)
    rows = {"a": START, "b": START + day, "c": START + 2 * day}
    first = spark.createDataFrame([(i, rows[i]) for i in "aba"], schema)
    second = spark.createDataFrame([(i, rows[i]) for i in "bc"], schema)
    sinks.log_append(first, folder)
    sinks.log_append(second, folder)
    back = sinks.log_read(spark, folder, first.schema)
    assert sorted(r.event_id for r in back.collect()) == ["a", "b", "c"]
    assert "PartitionFilters: [isnotnull(date" in plan_of(
        spark.read.parquet(folder).where("date = DATE '2024-05-02'")
    )


def test_log_append_does_not_hide_other_errors(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", START)], "event_id string, ts timestamp_ntz")
    sinks.log_append(rows, folder)
    with pytest.raises(AnalysisException):
        sinks.log_append(rows.withColumnRenamed("event_id", "id"), folder)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_points_of_a_time_range_prune_days(spark, tmp_path):
    folder = str(tmp_path / "points")
    day = dt.timedelta(days=1)
    points = spark.createDataFrame(
        [(START + n * day, "m", float(n), None, {}, "t") for n in range(5)],
        "ts timestamp_ntz, metric_name string, value double, metadata string, "
        "tags map<string,string>, metric_type string",
    )
    sinks.metrics_append(points, folder)
    some = sinks.metrics_read(spark, folder, F.lit(START + day), F.lit(START + 2 * day))
    assert sorted(r["value"] for r in some.collect()) == [1.0, 2.0]
    assert "PartitionFilters: [isnotnull(date" in plan_of(some)


def test_aggregates_write_loses_nothing(spark, tmp_path):
    folder = str(tmp_path / "aggs")
    schema = "metric_name string, metric_type string, granularity string, ts timestamp_ntz, count long"
    day = dt.timedelta(days=1)

    def write(*rows):
        frame = spark.createDataFrame([(m, "t", g, at, n) for m, g, at, n in rows], schema)
        sinks.aggregates_write(frame, folder)
        return frame.schema

    write(("a", "hour", START, 1), ("a", "hour", START + day, 2))
    write(("b", "hour", START, 3), ("a", "day", START, 4))
    shape = write(("a", "hour", START, 9))
    back = sinks.aggregates_read(spark, folder, shape).collect()
    assert sorted((r.metric_name, r.granularity, r["count"]) for r in back) == [
        ("a", "day", 4), ("a", "hour", 2), ("a", "hour", 9), ("b", "hour", 3),
    ]


def test_second_append_of_rows_without_a_time(spark, tmp_path):
    log, aggs = str(tmp_path / "log"), str(tmp_path / "aggs")
    events = spark.createDataFrame(
        [("a", None), ("b", START)], "event_id string, ts timestamp_ntz"
    )
    for _ in range(2):
        sinks.log_append(events, log)
    back = sinks.log_read(spark, log, events.schema).collect()
    assert sorted(r.event_id for r in back) == ["a", "b"]

    schema = "metric_name string, metric_type string, granularity string, ts timestamp_ntz, count long"
    for name, count in (("a", 1), ("b", 2), ("a", 3)):
        frame = spark.createDataFrame(
            [(name, "t", "hour", None, count), (name, "t", None, START, count)], schema
        )
        sinks.aggregates_write(frame, aggs)
    found = sinks.aggregates_read(spark, aggs, frame.schema).collect()
    assert sorted((r.metric_name, str(r.granularity), r["count"]) for r in found) == [
        ("a", "None", 3), ("a", "hour", 3), ("b", "None", 2), ("b", "hour", 2),
    ]


def test_sessions_without_address_and_after_logout(spark):
    hour = dt.timedelta(hours=1)
    sessions = spark.createDataFrame(
        [("s", 1, "10.0.0.1", START), ("n", 2, None, START), ("o", 3, "10.0.0.1", None)],
        "session_id string, user_id long, ip_address string, created_at timestamp_ntz",
    )
    ended = spark.createDataFrame([("s", START + hour)], "session_id string, ended_at timestamp_ntz")
    requests = spark.createDataFrame(
        [
            (1, "s", "10.0.0.1", START), (2, "s", None, START), (3, "s", "10.0.0.1", START + hour),
            (4, "n", None, START), (5, "n", "10.0.0.1", START), (6, "x", None, START),
            (7, "o", "10.0.0.1", START), (8, "n", None, START + 25 * hour),
        ],
        "request_id long, session_id string, ip_address string, ts timestamp_ntz",
    )
    rows = audit.session_validity(requests, sessions, ended).collect()
    assert {r.request_id: r.status for r in rows} == {
        1: "valid", 2: "ip_mismatch", 3: "unknown", 4: "valid", 5: "ip_mismatch", 6: "unknown",
        7: "valid", 8: "expired",
    }


def test_keyed_hash_of_any_secret(spark):
    for secret in ("k", "k" * 64, "k" * 65, "long " * 40):
        row = spark.range(1).select(hmac_sha256(secret, F.lit("message")).alias("h")).first()
        assert row.h == hmac.new(secret.encode(), b"message", "sha256").hexdigest()


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("f:a", "code", ["x"], 0.1), ("f:b", None, [], None)],
        "code_id string, code string, smells array<string>, score double",
    )
    sinks.graph_save(str(tmp_path), nodes=nodes)
    back = sinks.graph_load(spark, str(tmp_path), "nodes", nodes.schema)
    assert back.exceptAll(nodes).count() == 0 and nodes.exceptAll(back).count() == 0


def test_encryption_round_trip(spark):
    df = spark.createDataFrame([(1, "secret é"), (2, None)], "id int, email string")
    key = b"k" * 32
    sealed = privacy.encrypt_columns(df, ["email"], key)
    assert sealed.where("email like '%secret%'").count() == 0
    opened = privacy.decrypt_columns(sealed, ["email"], key)
    assert opened.exceptAll(df).count() == 0
    wrong = privacy.decrypt_columns(sealed, ["email"], b"x" * 32)
    assert wrong.where("email is not null").count() == 0


def test_anonymize_maps_and_nulls(spark):
    df = spark.createDataFrame(
        [("a@b.c", None, {"city": "X"}, 7)],
        "email string, phone string, address map<string,string>, n int",
    )
    row = privacy.anonymize(df, "salt").first()
    digest = lambda v: hashlib.sha256((v + "salt").encode()).hexdigest()[:8]
    assert row.email == digest("a@b.c")
    assert row.phone is None and row.n == 7
    assert row.address == digest('{"city":"X"}')


def test_retention_edges(spark):
    ages = [29, 30, 31, 89, 90, 91, 2555, 2556]
    df = spark.createDataFrame(
        [(a, START - dt.timedelta(days=a)) for a in ages], "age int, ts timestamp_ntz"
    )
    code = privacy.retention_action("code_analysis", F.col("ts"), ntz())
    bill = privacy.retention_action("billing_data", F.col("ts"), ntz())
    got = {r.age: (r.code, r.bill) for r in df.select("age", code.alias("code"), bill.alias("bill")).collect()}
    assert [got[a][0] for a in ages] == ["keep", "keep"] + ["purge"] * 6
    assert [got[a][1] for a in ages] == ["keep"] * 5 + ["anonymize"] * 2 + ["purge"]


def test_hmac_equals_the_standard_library(spark):
    messages = ["", "c1:trial:170", "é" * 100]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    got = {r.m: r.h for r in df.select("m", hmac_sha256("s3cret", F.col("m")).alias("h")).collect()}
    for m in messages:
        assert got[m] == hmac.new(b"s3cret", m.encode(), hashlib.sha256).hexdigest()


def test_license_keys(spark):
    now = 1_714_521_600
    cases = {
        f"TRIALabcdefgh{now}": ("trial", "abcdefgh", now),
        f"ENTERPRISE12345678{now - 2_592_000}": ("enterprise", "12345678", now - 2_592_000),
        f"STARTUPabcdefgh{now - 2_592_001}": (None, None, None),
        "TRIALabcdefghsoon": (None, None, None),
        "TRIALabc": (None, None, None),
        f"trialabcdefgh{now}": (None, None, None),
        "": (None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "license_key string")
    parsed = licenses.license_keys_parse(df, F.lit(now)).collect()
    assert {r.license_key: (r.plan_id, r.signature, r.issued_seconds) for r in parsed} == cases
    subs = spark.createDataFrame([("c1", "trial")], "customer_id string, plan_id string")
    issued = licenses.license_keys_issue(subs, "s", F.lit(now)).first().license_key
    mac = hmac.new(b"s", f"c1:trial:{now}".encode(), hashlib.sha256).hexdigest()
    assert issued == f"TRIAL{mac[:8]}{now}"


def test_license_status_without_end_and_unknown(spark):
    held = spark.createDataFrame(
        [(1, "trial", None, "p"), (2, "trial", START, "p"), (3, "startup", START, "p")],
        "license_id int, license_type string, expires_at timestamp_ntz, fingerprint string",
    )
    used = spark.createDataFrame(
        [(1, 1, "p"), (2, 2, "p"), (3, 3, "p"), (4, 1, "q"), (5, 9, "p")],
        "activation_id int, license_id int, fingerprint string",
    )
    at_end = licenses.license_status(held, used, ntz())
    later = licenses.license_status(held, used, ntz("2024-05-01 00:00:01"))
    assert [r.status for r in at_end.orderBy("activation_id").collect()] == [
        "valid",
        "valid",
        "valid",
        "invalid",
        "invalid",
    ]
    assert [r.status for r in later.orderBy("activation_id").collect()] == [
        "valid",
        "trial_expired",
        "expired",
        "invalid",
        "invalid",
    ]


def test_default_plans_and_subscription(spark):
    plans = billing.default_plans(spark)
    assert [str(r.price) for r in plans.orderBy("price").collect()] == ["0.00", "99.00", "990.00"]
    asked = spark.createDataFrame(
        [(1, "c", "startup", START), (2, "c", "gone", START)],
        "subscription_id int, customer_id string, plan_id string, start_date timestamp_ntz",
    )
    created, rejected = billing.subscribe(asked, plans)
    row = created.first()
    assert (row.status, row.end_date - START, row.trial_end_date - START) == (
        "trial",
        dt.timedelta(days=30),
        dt.timedelta(days=14),
    )
    assert [r.subscription_id for r in rejected.collect()] == [2]


def test_alert_ids_and_conditions(spark):
    rows = [
        ("system_cpu_usage_percent", START, 80.0),
        ("system_cpu_usage_percent", START + dt.timedelta(milliseconds=500), 99.0),
        ("system_cpu_usage_percent", START + dt.timedelta(seconds=1), 79.9),
        ("unknown", START, 1e9),
    ]
    samples = spark.createDataFrame(rows, "metric string, ts timestamp_ntz, value double")
    raised = monitoring.alerts(samples, monitoring.alert_rules(spark)).collect()
    assert [(r.alert_id, r.current_value) for r in raised] == [("high_cpu_usage_1714521600", 80.0)]
    extra = ("own", "unknown", None, 5.0, "low", "own rule")
    more = monitoring.alerts(samples, monitoring.alert_rules(spark, [extra]))
    assert more.count() == 2


def test_health_details(spark):
    samples = spark.createDataFrame(
        [(1, 9.99, 95.5), (2, 10.0, 90.0)],
        "run_id int, disk_free_percent double, memory_percent double",
    )
    checks = monitoring.host_checks(samples)
    details = {r.detail for r in checks.collect()}
    assert details == {"Low disk space: 10.0% free", "High memory usage: 95.5%", None}
    status = {r.run_id: r.overall_status for r in monitoring.health_rollup(checks).collect()}
    assert status == {1: "unhealthy", 2: "healthy"}


def test_recorders_keep_tags_and_metadata(spark):
    records = spark.createDataFrame(
        [(START, "a.py", ["x", "y"])], "ts timestamp_ntz, file_path string, issues array<string>"
    )
    row = recorders.security_points(records).first()
    assert (row.value, row.metadata, row.tags) == (
        2.0,
        '{"issues":["x","y"]}',
        {"file_path": "a.py"},
    )


def test_overview_without_data_shows_stable_zero(spark):
    points = spark.createDataFrame(
        [], "metric_name string, metric_type string, ts timestamp_ntz, value double"
    )
    aggs = ts.aggregate_tumbling(points, "minute")
    rows = ts.metrics_report(aggs, ntz()).collect()
    assert len(rows) == 9
    assert {(r.current, r.trend) for r in rows if r.section != "usage"} == {(0.0, "stable")}
    assert {(r.total, r.success_rate) for r in rows if r.section == "usage"} == {(0, 0.0)}


@pytest.mark.parametrize("most", [similarity.MAX_BROADCAST_QUERIES, 3])
def test_similar_code_on_both_paths(spark, monkeypatch, most):
    rng = np.random.default_rng(0)
    corpus, wanted = rng.normal(size=(60, 8)), rng.normal(size=(9, 8))
    corpus[0] = 0
    monkeypatch.setattr(similarity, "MAX_BROADCAST_QUERIES", most)
    monkeypatch.setattr(similarity, "_CORPUS_BLOCK", 25)
    monkeypatch.setattr(similarity, "_ROWS_AT_ONCE", 7)
    schema = "{} string, embedding array<float>"
    vectors = spark.createDataFrame(
        [(f"v{i}", [float(x) for x in v]) for i, v in enumerate(corpus)], schema.format("id")
    )
    queries = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(wanted)], schema.format("query_id")
    )
    got = {(r.query_id, r.id) for r in similarity.similar_code(vectors, queries, 0.4).collect()}
    norm = np.linalg.norm(wanted, axis=1)[:, None] * np.linalg.norm(corpus, axis=1)[None, :]
    scores = (wanted @ corpus.T) / np.maximum(norm, 1e-8)
    assert got == {(f"q{a}", f"v{b}") for a, b in zip(*np.nonzero(scores >= 0.4))}
    top = similarity.similar_code(vectors, queries, 0.0, top=2)
    assert top.count() == 18


def test_describe_hits(spark):
    hits = spark.createDataFrame(
        [("q", "func:f", 0.9), ("q", "file:a.py", 0.8)],
        "query_id string, id string, similarity double",
    )
    nodes = spark.createDataFrame(
        [("func:f", "func", "f", "x/a.py", 2, 3, 50.0), ("file:a.py", "file", "a.py", "x/a.py", 1, 9, 60.0)],
        "code_id string, kind string, name string, path string, cyclomatic int, loc int, "
        "maintainability double",
    )
    got = {r.id: (r.purpose, r.loc) for r in similarity.describe_hits(hits, nodes).collect()}
    assert got == {"func:f": ("Function: f", 3), "file:a.py": ("File: x/a.py", 9)}


@pytest.mark.parametrize(
    "setting, own, master, expected",
    [
        ("/shared/x/", None, "spark://host", "/shared/x/tallyglass/app-1/p-"),
        (None, "file:/cp", "spark://host", "file:/cp/tallyglass/app-1/p-"),
        (None, None, "local[2]", "/tmp/"),
        (None, None, "spark://host", None),
    ],
)
def test_work_folder_follows_the_session(monkeypatch, setting, own, master, expected):
    monkeypatch.setattr("tempfile.mkdtemp", lambda prefix: f"/tmp/{prefix}")
    chosen = []
    context = SimpleNamespace(
        master=master,
        applicationId="app-1",
        getCheckpointDir=lambda: own,
        setCheckpointDir=chosen.append,
    )
    conf = SimpleNamespace(get=lambda key, default: setting)
    session = SimpleNamespace(conf=conf, sparkContext=context)
    if expected is None:
        with pytest.raises(ValueError):
            work_folder(session, "p")
    else:
        assert work_folder(session, "p").startswith(expected)
    assert bool(chosen) == (expected == "/tmp/")


def test_open_root_understands_local_uris():
    for root in ("/a/b/", "file:/a/b", "file:///a/b"):
        assert files.open_root(root)[1] == "/a/b"


def test_encode_incremental_reuses_and_encodes_once(spark):
    snippets = spark.createDataFrame(
        [(1, "a b"), (2, "a b"), (3, "c"), (4, ""), (5, None)], "id int, code string"
    )
    calls = []

    def encode(df):
        calls.append(df.count())
        return similarity.encode_model(df, "key", "code", similarity.hashing_model(8))

    store = encode(
        spark.createDataFrame([("c",)], "code string").select(
            similarity.snippet_key("m", "code").alias("key"), "code"
        )
    )
    vectors, fresh = similarity.encode_incremental(snippets, store, encode, "m")
    assert calls == [1, 2]
    assert {r.id: r.reused for r in vectors.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert fresh.count() == 2


def test_similar_code_near_one_compares_only_close_vectors(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MAX_BROADCAST_QUERIES", 7)
    monkeypatch.setattr(similarity, "_CORPUS_BLOCK", 11)
    random = np.random.default_rng(3)
    middles = random.normal(size=(30, 24))
    rows = middles[random.integers(0, 30, 400)]
    rows = (rows + random.normal(size=rows.shape) * random.choice([0.0, 0.01, 0.05], (400, 1)))
    rows *= random.uniform(0.1, 9, (400, 1))
    rows[5], rows[6, 3] = 0, np.nan
    every = [(f"v{i}", v.tolist()) for i, v in enumerate(rows)]
    every += [("none", None), ("short", [1.0, 2.0]), ("same", [2.0, 4.0])]
    vectors = spark.createDataFrame(every, "id string, embedding array<double>")
    queries = vectors.withColumnRenamed("id", "query_id")
    for threshold in (0.999, 0.99999):
        cosines = similarity._cosines(rows, rows)
        wanted = {(f"v{i}", f"v{j}") for i, j in zip(*np.nonzero(cosines >= threshold))}
        wanted |= {(a, b) for a in ("short", "same") for b in ("short", "same")}
        found = similarity.similar_code(vectors, queries, threshold).collect()
        assert len(found) == len(wanted) and {(r.query_id, r.id) for r in found} == wanted
        best = similarity.similar_code(vectors, queries, threshold, top=2)
        assert best.count() == sum(min(2, sum(a == q for a, _ in wanted)) for q in {a for a, _ in wanted})
    reach = similarity._reach(0.99999)
    own, cells = similarity._cells(rows, reach, False)
    _, near = similarity._cells(rows, reach, True)
    assert len(own) == 398 == len(set(own.tolist()))
    assert sum(int((near == c).sum()) for c in cells.tolist()) < 398 * 398 / 5


def _alike(count: int, groups: int = 12, width: int = 24):
    """Groups of vectors that lie near one direction, as those of texts full of blanks do."""
    random = np.random.default_rng(5)
    rows = random.normal(0, 0.02, (groups, width))[random.integers(0, groups, count)]
    rows = rows + random.normal(size=rows.shape) * random.choice([0.0, 1e-4, 2e-3], (count, 1))
    rows[:, 0] += 1
    return rows * random.uniform(0.5, 2, (count, 1))


@pytest.mark.parametrize("small", [skew.SMALL_ROWS, 0])
def test_similar_code_near_one_moves_few_vectors(spark, monkeypatch, small):
    """Vectors that random directions do not part are neither all compared nor sent many times."""
    rows = _alike(300)
    monkeypatch.setattr(similarity, "MAX_BROADCAST_QUERIES", 5)
    monkeypatch.setattr(similarity, "SMALL_ROWS", small, raising=False)
    moved, matched = [], similarity._matched

    def counted(left, right, *others):
        moved.append((left.count(), right.count()))
        return matched(left, right, *others)

    monkeypatch.setattr(similarity, "_matched", counted)
    vectors = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(rows)], "id string, embedding array<double>")
    queries = vectors.where("id like '%1'").withColumnRenamed("id", "query_id")
    cosines = similarity._cosines(rows, rows)
    wanted = {(f"v{i}", f"v{j}") for i, j in zip(*np.nonzero(cosines >= 0.99999)) if i % 10 == 1}
    assert 30 < len(wanted) < 2_000
    found = similarity.similar_code(vectors, queries, 0.99999).collect()
    assert len(found) == len(wanted) and {(r.query_id, r.id) for r in found} == wanted
    assert moved[0][0] <= 300 and moved[0][1] <= 30 * 8
    # Blocks of a few rows: the same pairs, each once.
    monkeypatch.setattr(similarity, "_CELL_NUMBERS", 256 * 7)
    found = similarity.similar_code(vectors, queries, 0.99999).collect()
    assert len(found) == len(wanted) and {(r.query_id, r.id) for r in found} == wanted
    assert sum(moved[1]) > sum(moved[0])


def test_cells_along_the_widest_directions_lose_no_pair():
    rows = _alike(300)
    reach = similarity._reach(0.99999)
    spread = similarity._spread_of(rows[:100])
    own, cells = similarity._cells(rows, reach, False, spread)
    asked, near = similarity._cells(rows, reach, True, spread)
    assert own.tolist() == list(range(300)) and len(set(zip(asked, near))) == len(asked)
    pairs = {(q, v) for q, c in zip(asked, near) for v in np.flatnonzero(cells == c)}
    assert pairs >= set(zip(*np.nonzero(similarity._cosines(rows, rows) >= 0.99999)))
    assert len(pairs) < 300 * 300 / 4
    for odd in (np.ones((3, 5)), np.zeros((3, 5)), rows[:1], np.ones((4, 1))):
        directions = similarity._spread_of(odd).directions
        assert np.allclose(directions.T @ directions, np.eye(directions.shape[1]))


def test_close_hits_are_the_hits(monkeypatch):
    rows = _alike(200)
    rows[3], rows[4, 2], rows[5] = 0, np.nan, rows[5] * 1e-7
    vectors = similarity._Vectors(pa.array([f"v{i}" for i in range(200)]), rows)

    def pairs(batches):
        return sorted(tuple(r.values()) for b in batches for r in b.to_pylist())

    for threshold in (0.999, 0.99999, 1 - 1e-12):
        wanted = pairs(similarity._hits({24: vectors}, {24: vectors}, threshold, None))
        with monkeypatch.context() as few:
            few.setattr(similarity, "MAX_BROADCAST_QUERIES", 9)
            few.setattr(similarity, "_ROWS_AT_ONCE", 7)
            found = pairs(similarity._close_hits({24: vectors}, {24: vectors}, threshold))
        assert [f[:2] for f in found] == [w[:2] for w in wanted] and len(wanted) > 150
        assert np.allclose([f[2] for f in found], [w[2] for w in wanted], atol=1e-12, rtol=0)


def test_described_hits_are_found_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "_is_small", lambda df, most: False)
    found = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            found.add(batch.num_rows)
            yield batch

    hits = spark.range(50).selectExpr("'q' as query_id", "concat('func:', id) as id", "1.0D as similarity")
    nodes = spark.range(40).selectExpr(
        "concat('func:', id) as code_id", "'func' as kind", "'f' as name", "'a.py' as path",
        "1 as cyclomatic", "2 as loc", "3.0D as maintainability",
    )
    rows = similarity.describe_hits(hits.mapInArrow(told, hits.schema), nodes).collect()
    assert len(rows) == 50 and sum(r.loc == 2 for r in rows) == 40
    assert found.value == 50


def test_described_classes_are_not_joined_with_their_vectors(spark, tmp_path, monkeypatch, capsys):
    """No node's text is stored beside its vector, and the vectors of classes come from one scan."""
    parts = spark.range(1200).selectExpr(
        "id as p_partkey", "cast(id % 50 as int) as p_size", "concat('Brand#', id % 3 + 1) as p_brand"
    )
    parts.write.parquet(f"{tmp_path}/part.parquet")
    kept, search = [], similarity.similar_code

    def keep(df, purpose):
        kept.append(df.columns)
        return stored(df, purpose)

    def explained(vectors, queries, threshold):
        queries.explain()
        return search(vectors, queries, threshold)

    monkeypatch.setattr(plan, "stored", keep)
    monkeypatch.setattr(similarity, "similar_code", explained)
    rows = plan.similar_code_described(spark, str(tmp_path)).collect()
    ids = {f"class:Cls_{b}_{bk}" for b in (1, 2, 3) for bk in (0, 1, 2)}
    assert {r.query_id for r in rows} == ids and all((r.query_id, r.id) in {(i, i) for i in ids} for r in rows)
    assert "Join" not in capsys.readouterr().out
    assert len(kept) == 1 and "embedding" in kept[0] and "code" not in kept[0]


def test_encode_model_takes_few_texts_at_once(spark, monkeypatch):
    def make_predict():
        return lambda texts: np.array([[len(texts), len(t), sum(map(len, texts))] for t in texts], dtype=float)

    texts = ["x" * 600_000] * 4 + ["a", None, ""] * 40 + ["y" * 3_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, t string").coalesce(1)
    encoded = similarity.encode_model(docs, "doc", "t", make_predict)
    assert encoded.columns == ["doc", "embedding"]
    got = {r.doc: r.embedding for r in encoded.collect()}
    assert [got[i][1] for i in range(len(texts))] == [len(t or "") for t in texts]
    assert max(v[0] for v in got.values()) <= 32
    assert all(v[2] <= similarity._TEXT_BYTES or v[0] == 1 for v in got.values())


def test_hashing_model_gives_zeros_where_counts_cancel():
    predict = similarity.hashing_model(1)()
    words = [w for w in map(str, range(100)) if predict([w])[0, 0] < 0]
    sign = predict(["."])[0, 0]
    other = next(w for w in map(str, range(100)) if predict([w])[0, 0] == -sign)
    assert words and predict([f"{other}.", "", "."]).tolist() == [[0.0], [0.0], [sign]]


def test_token_counts(spark):
    texts = ["", "a a_1 ä,a", "x" * 600 + " y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", token_counts(F.col("t")).alias("c")).collect()
    got = {r.t: {x.token: x.n for x in r.c} for r in rows}
    assert got[""] == {}
    assert got["a a_1 ä,a"] == {"a": 2, "a_1": 1, "ä": 1, ",": 1, " ": 2}
    assert got[texts[2]] == {"x" * 600: 1, " ": 1, "y": 1}
    cut = df.select(token_counts(F.col("t"), 512).alias("c")).collect()[2].c
    assert [(x.token, x.n) for x in cut] == [("x" * 512, 1)]
