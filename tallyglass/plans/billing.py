"""Billing and licence queries over ``part``, ``customer``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import billing, licenses
from .registry import at, query, table

PLANS_SQL = """plans AS (SELECT CASE WHEN p_partkey = 1 THEN 'startup' ELSE 'p' || p_partkey END AS plan_id,
  p_name AS name, p_type AS description, CAST(p_retailprice AS DECIMAL(12, 2)) AS price,
  CASE p_size % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' ELSE 'yearly' END AS billing_cycle,
  1 AS max_prod, CAST(p_size AS INT) AS max_nonprod, ['basic_analysis'] AS features,
  CAST(p_size % 20 AS INT) AS trial_days, p_partkey % 4 > 0 AS active FROM part)"""
PLAN_COLUMNS = (
    "plan_id, name, description, CAST(price AS DOUBLE) AS price, billing_cycle, max_prod, "
    "max_nonprod, array_to_string(features, ',') AS features, trial_days"
)


def part_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.when(key == 1, "startup")
        .otherwise(F.concat(F.lit("p"), key.cast("string")))
        .alias("plan_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        F.when(size % 3 == 0, "monthly")
        .when(size % 3 == 1, "quarterly")
        .otherwise("yearly")
        .alias("billing_cycle"),
        F.lit(1).alias("max_prod"),
        size.cast("int").alias("max_nonprod"),
        F.array(F.lit("basic_analysis")).alias("features"),
        (size % 20).cast("int").alias("trial_days"),
        (key % 4 > 0).alias("active"),
    )


def flat(plans: DataFrame) -> DataFrame:
    return plans.withColumns(
        {"price": F.col("price").cast("double"), "features": F.array_join("features", ",")}
    )


@query("active_plans", f"WITH {PLANS_SQL} SELECT {PLAN_COLUMNS} FROM plans WHERE active")
def active_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(billing.active_plans(part_plans(spark, sf_dir)))


@query(
    "plan_seed",
    f"""WITH {PLANS_SQL}, defaults AS (SELECT * FROM (VALUES
  ('trial', 'Trial', 'Plan de prueba gratuito', 0.0, 'monthly', 1, 1,
    'basic_analysis,basic_testing', 30),
  ('startup', 'Startup', 'Plan para startups y proyectos pequeños', 99.0, 'monthly', 1, 2,
    'basic_analysis,basic_testing,advanced_metrics', 14),
  ('enterprise', 'Enterprise', 'Plan empresarial con características avanzadas', 990.0, 'monthly', 3, 5,
    'basic_analysis,basic_testing,advanced_metrics,security_analysis,custom_reports', 7))
  AS d(plan_id, name, description, price, billing_cycle, max_prod, max_nonprod, features, trial_days))
SELECT {PLAN_COLUMNS}, active FROM plans
UNION ALL SELECT *, true FROM defaults WHERE plan_id NOT IN (SELECT plan_id FROM plans)""",
)
def plan_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(billing.plan_seed(part_plans(spark, sf_dir)))


def email(key):
    return F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com"))


@query(
    "customer_upsert",
    """WITH existing AS (SELECT 'c' || c_custkey AS customer_id, 'user' || c_custkey || '@example.com' AS email,
  c_name AS name, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM customer),
incoming AS (SELECT 'user' || (o_custkey * 2) || '@example.com' AS email, 'Order ' || o_orderkey AS name FROM orders)
SELECT * FROM existing
UNION ALL SELECT substr(sha256(email), 1, 32), email, min(name), TIMESTAMP '2024-02-01 00:00:00'
FROM incoming WHERE email NOT IN (SELECT email FROM existing) GROUP BY email""",
)
def customer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    start = at("2024-01-01 00:00:00")
    existing = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("customer_id"),
        email(F.col("c_custkey")).alias("email"),
        F.col("c_name").alias("name"),
        none.alias("company"),
        none.alias("phone"),
        start.alias("created_at"),
        start.alias("updated_at"),
    )
    incoming = table(spark, sf_dir, "orders").select(
        email(F.col("o_custkey") * 2).alias("email"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"),
        none.alias("company"),
        none.alias("phone"),
    )
    merged = billing.customer_upsert(existing, incoming, at("2024-02-01 00:00:00"))
    return merged.select("customer_id", "email", "name", "created_at")


# Plan asked for by each market segment (fixed values of the fixture); the plan
# of MACHINERY does not exist.
PLAN_OF = {
    "AUTOMOBILE": "p0",
    "BUILDING": "startup",
    "FURNITURE": "p2",
    "HOUSEHOLD": "p3",
    "MACHINERY": "none",
}
PLAN_OF_SQL = (
    "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLAN_OF.items()) + " END"
)
REQUESTS_SQL = f"""asked AS (SELECT o_orderkey AS subscription_id, o_custkey AS customer_id,
  {PLAN_OF_SQL} AS plan_id, o_orderdate AS start_date, o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
CREATED_SQL = """created AS (SELECT subscription_id, customer_id, plan_id,
  CASE WHEN trial_days > 0 THEN 'trial' ELSE 'active' END AS status, start_date,
  start_date + INTERVAL 1 DAY * (CASE billing_cycle WHEN 'quarterly' THEN 90 WHEN 'yearly' THEN 365 ELSE 30 END) AS end_date,
  CASE WHEN trial_days > 0 THEN start_date + INTERVAL 1 DAY * trial_days END AS trial_end_date,
  o_orderstatus FROM asked JOIN plans USING (plan_id))"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = F.create_map(*[F.lit(x) for pair in PLAN_OF.items() for x in pair])
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), plan[F.col("c_mktsegment")].alias("plan_id")
    )
    return table(spark, sf_dir, "orders").join(customers, "o_custkey").select(
        F.col("o_orderkey").alias("subscription_id"),
        F.col("o_custkey").alias("customer_id"),
        "plan_id",
        F.col("o_orderdate").alias("start_date"),
        "o_orderstatus",
    )


@query(
    "subscribe",
    f"""WITH {PLANS_SQL}, {REQUESTS_SQL}, {CREATED_SQL}
SELECT subscription_id, customer_id, plan_id, status, start_date, end_date, trial_end_date FROM created""",
)
def subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    created, _ = billing.subscribe(
        asked(spark, sf_dir).drop("o_orderstatus"), part_plans(spark, sf_dir)
    )
    return created.drop("auto_renew", "created_at", "updated_at")


@query(
    "subscribe_rejected",
    f"""WITH {PLANS_SQL}, {REQUESTS_SQL} SELECT subscription_id, customer_id, plan_id FROM asked
WHERE plan_id NOT IN (SELECT plan_id FROM plans)""",
)
def subscribe_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = billing.subscribe(asked(spark, sf_dir), part_plans(spark, sf_dir))
    return rejected.select("subscription_id", "customer_id", "plan_id")


# Subscriptions of finished orders are no longer running.
SUBS_SQL = f"""{PLANS_SQL}, {REQUESTS_SQL}, {CREATED_SQL},
subs AS (SELECT subscription_id, customer_id, plan_id,
  CASE WHEN o_orderstatus = 'F' THEN 'expired' ELSE status END AS status, start_date AS created_at,
  start_date AS updated_at, end_date FROM created),
current_sub AS (SELECT * FROM subs WHERE status IN ('active', 'trial')
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, subscription_id DESC) = 1)"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = asked(spark, sf_dir)
    created, _ = billing.subscribe(requests.drop("o_orderstatus"), part_plans(spark, sf_dir))
    done = requests.where(F.col("o_orderstatus") == "F").select(
        "subscription_id", F.lit(True).alias("_done")
    )
    joined = created.join(done, "subscription_id", "left")
    return joined.withColumn(
        "status", F.when(F.col("_done"), "expired").otherwise(F.col("status"))
    ).drop("_done")


@query(
    "active_subscription",
    f"""WITH {SUBS_SQL} SELECT customer_id, subscription_id, plan_id, status, created_at FROM current_sub""",
)
def active_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = billing.active_subscription(subscriptions(spark, sf_dir))
    return current.select("customer_id", "subscription_id", "plan_id", "status", "created_at")


@query(
    "cancel_subscription",
    f"""WITH {SUBS_SQL}, ended AS (SELECT subscription_id FROM current_sub
  WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000))
SELECT subscription_id, customer_id,
  CASE WHEN subscription_id IN (SELECT * FROM ended) THEN 'cancelled' ELSE status END AS status,
  CASE WHEN subscription_id IN (SELECT * FROM ended) THEN TIMESTAMP '2024-02-01 00:00:00' ELSE updated_at END AS updated_at
FROM subs""",
)
def cancel_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaving = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 2000)
    leaving = leaving.select(F.col("c_custkey").alias("customer_id"))
    after = billing.cancel_subscription(
        subscriptions(spark, sf_dir), leaving, at("2024-02-01 00:00:00")
    )
    return after.select("subscription_id", "customer_id", "status", "updated_at")


@query(
    "usage_stats",
    f"""WITH {SUBS_SQL}, used AS (SELECT o_custkey AS customer_id, count(*) AS prod_environments,
  count(DISTINCT o_orderpriority) AS nonprod_environments FROM orders GROUP BY o_custkey)
SELECT c_custkey AS customer_id, subscription_id, s.plan_id, prod_environments, nonprod_environments,
  max_prod, max_nonprod, end_date AS next_billing_date,
  CASE WHEN subscription_id IS NOT NULL THEN true END AS auto_renew,
  CASE WHEN subscription_id IS NULL THEN 'no active subscription' END AS error
FROM customer LEFT JOIN current_sub s ON s.customer_id = c_custkey
LEFT JOIN plans ON plans.plan_id = s.plan_id LEFT JOIN used ON used.customer_id = c_custkey""",
)
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    used = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(
            F.count(F.lit(1)).alias("prod_environments"),
            F.countDistinct("o_orderpriority").alias("nonprod_environments"),
        )
    )
    return billing.usage_stats(
        customers, subscriptions(spark, sf_dir), part_plans(spark, sf_dir), used
    )


INVOICES_SQL = """invoices AS (SELECT o_orderkey AS invoice_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  round(o_totalprice, 2) AS amount, 'USD' AS currency, 'pending' AS status,
  coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 10 DAY END, o_orderdate + INTERVAL 30 DAY) AS due_date,
  CAST(NULL AS TIMESTAMP) AS paid_date, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, '') AS description,
  o_orderdate AS created_at FROM orders)"""


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").select(
        key.alias("invoice_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        key.alias("subscription_id"),
        F.col("o_totalprice").alias("amount"),
        F.when(key % 3 == 0, F.col("o_orderdate") + F.make_dt_interval(F.lit(10))).alias("due_date"),
        F.when(key % 2 == 0, F.col("o_orderpriority")).alias("description"),
        F.col("o_orderdate").alias("created_at"),
    )
    return billing.invoice_create(requests)


def shown(df: DataFrame) -> DataFrame:
    return df.drop("subscription_id").withColumn("amount", F.col("amount").cast("double"))


@query("invoice_create", f"WITH {INVOICES_SQL} SELECT * FROM invoices")
def invoice_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(invoices(spark, sf_dir))


@query("customer_invoices", f"WITH {INVOICES_SQL} SELECT * FROM invoices")
def customer_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(billing.customer_invoices(invoices(spark, sf_dir)))


PAYMENTS_SQL = """payments AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS payment_id,
  CASE WHEN l_partkey % 50 = 0 THEN -l_orderkey ELSE l_orderkey END AS invoice_id,
  round(l_extendedprice, 2) AS amount,
  CASE WHEN l_linestatus = 'F' THEN 'paypal' ELSE 'stripe' END AS method,
  't' || l_suppkey AS transaction_id, l_shipdate AS processed_at FROM lineitem)"""


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            "-", order.cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
        ).alias("payment_id"),
        F.when(F.col("l_partkey") % 50 == 0, -order).otherwise(order).alias("invoice_id"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_linestatus") == "F", "paypal").otherwise("stripe").alias("method"),
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("transaction_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("processed_at"),
    )


@query(
    "payment_apply",
    f"""WITH {INVOICES_SQL}, {PAYMENTS_SQL}
SELECT payment_id, p.invoice_id, coalesce(i.customer_id, '') AS customer_id, p.amount, 'USD' AS currency,
  method, 'completed' AS status, transaction_id, CAST(processed_at AS TIMESTAMP) AS processed_at
FROM payments p LEFT JOIN invoices i ON i.invoice_id = p.invoice_id""",
)
def payment_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    booked, _ = billing.payment_apply(invoices(spark, sf_dir), payments(spark, sf_dir))
    return booked.withColumn("amount", F.col("amount").cast("double"))


@query(
    "payment_settled",
    f"""WITH {INVOICES_SQL}, {PAYMENTS_SQL},
paid AS (SELECT invoice_id, CAST(max(processed_at) AS TIMESTAMP) AS latest FROM payments GROUP BY invoice_id)
SELECT i.invoice_id, customer_id, CASE WHEN latest IS NOT NULL THEN 'completed' ELSE status END AS status,
  coalesce(latest, paid_date) AS paid_date FROM invoices i LEFT JOIN paid ON paid.invoice_id = i.invoice_id""",
)
def payment_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, settled = billing.payment_apply(invoices(spark, sf_dir), payments(spark, sf_dir))
    return settled.select("invoice_id", "customer_id", "status", "paid_date")


NOW = 1_706_745_600  # 2024-02-01 00:00:00
KEYS_SQL = f"""keys AS (SELECT c_custkey AS customer_id,
  CASE c_nationkey % 5 WHEN 0 THEN 'TRIAL' WHEN 1 THEN 'STARTUP' WHEN 2 THEN 'ENTERPRISE' WHEN 3 THEN 'GOLD' ELSE 'TRIAL' END
  || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)
  || CASE WHEN c_custkey % 10 = 0 THEN 'soon' ELSE CAST({NOW} - c_custkey * 3600 AS VARCHAR) END AS license_key
  FROM customer)"""


def license_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, kind = F.col("c_custkey"), F.col("c_nationkey") % 5
    prefix = (
        F.when(kind == 1, "STARTUP").when(kind == 2, "ENTERPRISE").when(kind == 3, "GOLD")
    ).otherwise("TRIAL")
    issued = F.when(customer % 10 == 0, "soon").otherwise((NOW - customer * 3600).cast("string"))
    signature = F.substring(F.sha2(customer.cast("string"), 256), 1, 8)
    return table(spark, sf_dir, "customer").select(
        customer.alias("customer_id"), F.concat(prefix, signature, issued).alias("license_key")
    )


@query(
    "license_keys_parse",
    f"""WITH {KEYS_SQL}, cut AS (
  SELECT *, regexp_extract(license_key, '^(TRIAL|STARTUP|ENTERPRISE)', 1) AS prefix FROM keys),
parsed AS (SELECT *, TRY_CAST(substr(license_key, len(prefix) + 9) AS BIGINT) AS issued FROM cut WHERE prefix <> '')
SELECT customer_id, license_key, CASE WHEN fine THEN lower(prefix) END AS plan_id,
  CASE WHEN fine THEN substr(license_key, len(prefix) + 1, 8) END AS signature,
  CASE WHEN fine THEN issued END AS issued_seconds
FROM (SELECT *, issued IS NOT NULL AND {NOW} - issued <= 2592000 AS fine FROM parsed
  UNION ALL SELECT *, NULL, false FROM cut WHERE prefix = '')""",
)
def license_keys_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_keys_parse(license_keys(spark, sf_dir), F.lit(NOW))


def _pad_sql(byte: int) -> str:
    block = bytes(b ^ byte for b in b"webhook-secret".ljust(64, b"\0"))
    return f"unhex('{block.hex()}')"


@query(
    "license_keys_issue",
    f"""WITH {REQUESTS_SQL}, signed AS (
  SELECT subscription_id, customer_id, plan_id,
    sha256({_pad_sql(0x5C)} || unhex(sha256({_pad_sql(0x36)}
      || encode(customer_id || ':' || plan_id || ':' || {NOW})))) AS mac FROM asked)
SELECT subscription_id, upper(plan_id) || substr(mac, 1, 8) || {NOW} AS license_key FROM signed""",
)
def license_keys_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued = licenses.license_keys_issue(asked(spark, sf_dir), "webhook-secret", F.lit(NOW))
    return issued.select("subscription_id", "license_key")


@query(
    "license_entitlements",
    f"""WITH {KEYS_SQL}, terms AS (SELECT * FROM (VALUES
  ('TRIAL', 'basic_analysis,basic_testing', 1, 1, 30),
  ('STARTUP', 'basic_analysis,basic_testing,advanced_metrics', 1, 2, 365),
  ('ENTERPRISE', 'basic_analysis,basic_testing,advanced_metrics,security_analysis,custom_reports', 3, 5, 365))
  AS t(prefix, features, max_prod, max_nonprod, days))
SELECT customer_id, prefix IS NOT NULL AS valid, lower(prefix) AS license_type, features, max_prod, max_nonprod,
  CASE WHEN prefix IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS issued_at,
  TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 DAY * days AS expires_at
FROM keys LEFT JOIN terms ON starts_with(license_key, prefix)""",
)
def license_entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = licenses.license_entitlements(
        license_keys(spark, sf_dir), at("2024-02-01 00:00:00")
    )
    return terms.drop("license_key").withColumn("features", F.array_join("features", ","))


LICENSES_SQL = """licenses AS (SELECT c_custkey AS license_id, c_custkey AS customer_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'trial' ELSE 'startup' END AS license_type,
  CASE WHEN c_nationkey > 0 THEN TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 HOUR * (c_custkey % 100 - 50) END AS expires_at,
  'fp' || (c_custkey % 9) AS fingerprint, c_mktsegment <> 'MACHINERY' AS has_metrics
  FROM customer WHERE c_acctbal > 0)"""


def owned_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    end = at("2024-02-01 00:00:00") + F.make_dt_interval(
        hours=(key % 100 - 50).cast("int")
    )
    basic = [F.lit("basic_analysis"), F.lit("basic_testing")]
    return table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(
        key.alias("license_id"),
        key.alias("customer_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "trial").otherwise("startup").alias("license_type"),
        F.when(F.col("c_nationkey") > 0, end).alias("expires_at"),
        F.concat(F.lit("fp"), (key % 9).cast("string")).alias("fingerprint"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.array(*basic))
        .otherwise(F.array(*basic, F.lit("advanced_metrics")))
        .alias("features"),
    )


@query(
    "license_status",
    f"""WITH {LICENSES_SQL}, used AS (SELECT o_orderkey AS activation_id, o_custkey AS license_id,
  'fp' || ((o_custkey + (o_orderkey % 4 = 0)::INT) % 9) AS fingerprint FROM orders)
SELECT activation_id, u.license_id, CASE WHEN l.license_id IS NULL OR l.fingerprint <> u.fingerprint THEN 'invalid'
  WHEN TIMESTAMP '2024-02-01 00:00:00' > expires_at AND license_type = 'trial' THEN 'trial_expired'
  WHEN TIMESTAMP '2024-02-01 00:00:00' > expires_at THEN 'expired' ELSE 'valid' END AS status
FROM used u LEFT JOIN licenses l ON l.license_id = u.license_id""",
)
def license_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = (F.col("o_orderkey") % 4 == 0).cast("int")
    used = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("activation_id"),
        F.col("o_custkey").alias("license_id"),
        F.concat(F.lit("fp"), ((F.col("o_custkey") + moved) % 9).cast("string")).alias("fingerprint"),
    )
    return licenses.license_status(
        owned_licenses(spark, sf_dir), used, at("2024-02-01 00:00:00")
    )


@query(
    "feature_access",
    f"""WITH {LICENSES_SQL} SELECT c_custkey AS customer_id, coalesce(has_metrics, false) AS access
FROM customer LEFT JOIN licenses ON customer_id = c_custkey""",
)
def feature_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    return licenses.feature_access(customers, owned_licenses(spark, sf_dir), "advanced_metrics")
