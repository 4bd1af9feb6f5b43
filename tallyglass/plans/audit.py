"""Audit, session, lockout and privacy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import seconds_interval
from ..operators import audit, privacy
from .registry import at, query, table

THREAT_SQL = """CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END"""
EVENTS_SQL = f"""audits AS (SELECT CAST(event_id AS VARCHAR) AS event_id, ts, event_type,
  {THREAT_SQL} AS threat_level, CAST(user_id AS VARCHAR) AS user_id, props AS metadata FROM events)"""


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    threat = F.when(kind == "error", "error").when(kind == "purchase", "warning").otherwise("info")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        "ts",
        "event_type",
        threat.alias("threat_level"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("props").alias("metadata"),
    )


@query(
    "audit_search",
    f"""WITH {EVENTS_SQL} SELECT * FROM audits
WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00'
  AND threat_level = 'info' AND event_type = 'signup'""",
)
def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = at("2024-01-03 00:00:00"), at("2024-01-28 00:00:00")
    return audit.audit_search(audit_events(spark, sf_dir), start, end, "signup", "info")


SESSIONS_SQL = """sessions AS (
  SELECT event_id AS session_id, user_id, '10.0.0.' || (user_id % 2) AS ip, ts AS created_at
  FROM events WHERE event_type = 'signup'),
requests AS (
  SELECT event_id AS request_id, event_id - event_id * 7 % 997 AS session_id,
    CASE WHEN event_id % 11 <> 0 THEN '10.0.0.' || (event_id % 2) END AS ip_address, ts
  FROM events WHERE event_type <> 'signup'),
ended AS (SELECT event_id AS session_id, ts + INTERVAL 1 HOUR AS ended_at
  FROM events WHERE event_type = 'signup' AND event_id % 5 = 0),
checked AS (
  SELECT request_id, r.session_id, ip_address, ts, s.user_id,
    CASE WHEN s.session_id IS NULL OR ts >= ended_at THEN 'unknown'
      WHEN s.ip IS DISTINCT FROM ip_address THEN 'ip_mismatch'
      WHEN ts > created_at + INTERVAL 24 HOUR THEN 'expired' ELSE 'valid' END AS status
  FROM requests r LEFT JOIN sessions s ON r.session_id = s.session_id
    LEFT JOIN ended e ON r.session_id = e.session_id)"""


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    sessions = events.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("session_id"),
        "user_id",
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 2).cast("string")).alias("ip_address"),
        F.col("ts").alias("created_at"),
    )
    requests = events.where(F.col("event_type") != "signup").select(
        F.col("event_id").alias("request_id"),
        (F.col("event_id") - F.col("event_id") * 7 % 997).alias("session_id"),
        F.when(
            F.col("event_id") % 11 != 0,
            F.concat(F.lit("10.0.0."), (F.col("event_id") % 2).cast("string")),
        ).alias("ip_address"),
        "ts",
    )
    ended = sessions.where(F.col("session_id") % 5 == 0).select(
        "session_id", (F.col("created_at") + seconds_interval(3600)).alias("ended_at")
    )
    return audit.session_validity(requests, sessions, ended)


@query(
    "session_validity",
    f"WITH {SESSIONS_SQL} SELECT request_id, session_id, ip_address, ts, user_id, status FROM checked",
)
def session_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity(spark, sf_dir).drop("expires_at")


@query(
    "session_violations",
    f"""WITH {SESSIONS_SQL} SELECT 'violation-' || request_id AS event_id, ts,
  'security_violation' AS event_type, 'error' AS threat_level, user_id, session_id, ip_address,
  'IP mismatch' AS description FROM checked WHERE status = 'ip_mismatch'""",
)
def session_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.session_violations(validity(spark, sf_dir))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "error")
        .select(
            F.col("event_id").alias("attempt_id"),
            F.col("user_id").cast("string").alias("identifier"),
            "ts",
            F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("ip_address"),
        )
    )


def _register_lockout(name: str, seconds: int) -> None:
    sql = f"""SELECT CAST(e.user_id AS VARCHAR) AS identifier, e.event_id, e.ts, count(f.ts) AS failures,
  count(f.ts) >= 5 AS blocked
FROM events e LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'error') f
  ON f.user_id = e.user_id AND f.ts > e.ts - INTERVAL {seconds} SECOND AND f.ts <= e.ts
GROUP BY ALL"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checks = table(spark, sf_dir, "events").select(
            F.col("user_id").cast("string").alias("identifier"), "event_id", "ts"
        )
        return audit.lockout(failures(spark, sf_dir), checks, window_seconds=seconds)


_register_lockout("lockout", 3 * 86_400)
_register_lockout("lockout_default", audit.LOCKOUT_SECONDS)


@query(
    "failed_attempt_events",
    """SELECT 'failed-' || event_id AS event_id, ts, 'security_violation' AS event_type,
  'warning' AS threat_level, '10.0.0.' || (user_id % 250) AS ip_address,
  'Failed attempt for ' || user_id AS description,
  '{"attempts":' || count(*) OVER (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL '259199.999999 seconds' PRECEDING AND CURRENT ROW) || '}' AS metadata
FROM events WHERE event_type = 'error'""",
)
def failed_attempt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.failed_attempt_events(failures(spark, sf_dir), 3 * 86_400)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("identifier"),
        "ts",
        F.col("event_id").alias("attempt_id"),
    )


RATE_SQL = """WITH RECURSIVE numbered AS (
  SELECT user_id, event_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
steps AS (
  SELECT user_id, event_id, n, [us] AS accepted, true AS allowed FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.user_id, x.event_id, x.n,
    CASE WHEN len([a FOR a IN s.accepted IF a > x.us - {width}]) < 5
      THEN list_append([a FOR a IN s.accepted IF a > x.us - {width}], x.us)
      ELSE [a FOR a IN s.accepted IF a > x.us - {width}] END,
    len([a FOR a IN s.accepted IF a > x.us - {width}]) < 5
  FROM steps s JOIN numbered x ON x.user_id = s.user_id AND x.n = s.n + 1)
SELECT CAST(user_id AS VARCHAR) AS identifier, event_id AS attempt_id, allowed FROM steps"""


def _register_rate_limit(name: str, seconds: int) -> None:
    @query(name, RATE_SQL.format(width=seconds * 1_000_000))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        decided = audit.rate_limit(attempts(spark, sf_dir), window_seconds=seconds)
        return decided.select("identifier", "attempt_id", "allowed")


_register_rate_limit("rate_limit", 12 * 3600)
_register_rate_limit("rate_limit_default", audit.RATE_SECONDS)


CUSTOMERS_SQL = """people AS (SELECT c_custkey AS customer_id, lower(c_name) || '@example.com' AS email,
  c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN '555-' || c_custkey END AS phone,
  c_mktsegment AS segment FROM customer)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("customer_id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"),
        F.when(key % 3 > 0, F.concat(F.lit("555-"), key.cast("string"))).alias("phone"),
        F.col("c_mktsegment").alias("segment"),
    )


def _hidden_sql(column: str) -> str:
    return f"substr(sha256({column} || 'pepper'), 1, 8)"


@query(
    "anonymize",
    f"""WITH {CUSTOMERS_SQL} SELECT customer_id, {_hidden_sql('email')} AS email,
  {_hidden_sql('name')} AS name, {_hidden_sql('phone')} AS phone, segment FROM people""",
)
def anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.anonymize(people(spark, sf_dir), "pepper")


@query(
    "retention",
    """WITH aged AS (
  SELECT 'event-' || event_id AS row_id, ts, 30 AS days FROM events
  UNION ALL SELECT 'order-' || o_orderkey, o_orderdate, 2555 FROM orders)
SELECT row_id, CASE WHEN ts < TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 1 DAY * days THEN 'purge'
  WHEN ts < TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 90 DAY THEN 'anonymize' ELSE 'keep' END AS action
FROM aged""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = at("2024-02-20 00:00:00")
    analyses = table(spark, sf_dir, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("row_id"),
        privacy.retention_action("code_analysis", F.col("ts"), now).alias("action"),
    )
    bills = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("row_id"),
        privacy.retention_action("billing_data", F.col("o_orderdate"), now).alias("action"),
    )
    return analyses.unionByName(bills)


@query(
    "retention_applied",
    f"""WITH bills AS (SELECT o_orderkey, o_orderdate, c_name AS name
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '2002-01-01 00:00:00' - INTERVAL 90 DAY
  THEN {_hidden_sql('name')} ELSE name END AS name
FROM bills WHERE o_orderdate >= TIMESTAMP '2002-01-01 00:00:00' - INTERVAL 2555 DAY""",
)
def retention_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name")
    )
    bills = table(spark, sf_dir, "orders").join(named, "o_custkey")
    bills = bills.select("o_orderkey", "o_orderdate", "name")
    return privacy.apply_retention(
        bills, "billing_data", "o_orderdate", at("2002-01-01 00:00:00"), "pepper"
    )


@query(
    "user_export",
    """WITH wanted AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT user_id, source, record_id FROM (
  SELECT c_custkey AS user_id, 'profile' AS source, CAST(c_custkey AS VARCHAR) AS record_id FROM customer
  UNION ALL SELECT o_custkey, 'billing', CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT user_id, 'events', CAST(event_id AS VARCHAR) FROM events)
WHERE user_id IN (SELECT user_id FROM wanted)""",
)
def user_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    tables = {
        "profile": (table(spark, sf_dir, "customer"), "c_custkey"),
        "billing": (table(spark, sf_dir, "orders"), "o_custkey"),
        "events": (events, "user_id"),
    }
    wanted = events.where(F.col("event_type") == "error").select("user_id")
    ids = ["$.event_id", "$.o_orderkey", "$.c_custkey"]
    record_id = F.coalesce(*[F.get_json_object("record", i) for i in ids])
    export = privacy.user_export(wanted, tables)
    return export.select("user_id", "source", record_id.alias("record_id"))


@query(
    "user_erase",
    """SELECT event_id, ts, user_id, event_type, value, props FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 150)""",
)
def user_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return privacy.user_erase(events, "user_id", events.where(F.col("value") > 150))


@query(
    "user_erase_events",
    """SELECT DISTINCT 'erase-' || user_id AS event_id, TIMESTAMP '2024-02-01 00:00:00' AS ts,
  'data_export' AS event_type, 'info' AS threat_level, user_id,
  'Data erasure requested for user ' || user_id AS description FROM events WHERE value > 150""",
)
def user_erase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").where(F.col("value") > 150)
    return privacy.erase_events(asked, at("2024-02-01 00:00:00"))


@query(
    "encrypt_columns",
    f"""WITH {CUSTOMERS_SQL} SELECT customer_id, email, phone, true AS hidden FROM people""",
)
def encrypt_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = b"0123456789abcdef"
    plain = people(spark, sf_dir).select("customer_id", "email", "phone")
    sealed = privacy.encrypt_columns(plain, ["email", "phone"], key)
    sealed = sealed.withColumn("_cipher", F.col("email"))
    opened = privacy.decrypt_columns(sealed, ["email", "phone"], key)
    return opened.select(
        "customer_id", "email", "phone", (F.col("_cipher") != F.col("email")).alias("hidden")
    )
