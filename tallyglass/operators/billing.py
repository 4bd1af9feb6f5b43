"""Plans, customers, subscriptions, invoices and payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import lookup_join, newest_rows
from ..functions.times import seconds_interval

DAY = 86_400
PLAN_SCHEMA = (
    "plan_id string, name string, description string, price decimal(12,2), billing_cycle string, "
    "max_prod int, max_nonprod int, features array<string>, trial_days int, active boolean"
)
# Days per billing cycle; others count as a month (fixed values).
CYCLE_DAYS = {"monthly": 30, "quarterly": 90, "yearly": 365}


def default_plans(spark: SparkSession) -> DataFrame:
    # Fixed values.
    basic = "array('basic_analysis', 'basic_testing')"
    startup = "array('basic_analysis', 'basic_testing', 'advanced_metrics')"
    enterprise = (
        "array('basic_analysis', 'basic_testing', 'advanced_metrics', 'security_analysis', "
        "'custom_reports')"
    )
    rows = f"""VALUES
      ('trial', 'Trial', 'Plan de prueba gratuito', 0.00, 'monthly', 1, 1, {basic}, 30, true),
      ('startup', 'Startup', 'Plan para startups y proyectos pequeños', 99.00, 'monthly', 1, 2,
        {startup}, 14, true),
      ('enterprise', 'Enterprise', 'Plan empresarial con características avanzadas', 990.00,
        'monthly', 3, 5, {enterprise}, 7, true)"""
    plans = spark.sql(rows).toDF(*[c.split()[0] for c in PLAN_SCHEMA.split(", ")])
    return plans.withColumn("price", F.col("price").cast("decimal(12,2)"))


def plan_seed(existing: DataFrame) -> DataFrame:
    """The plan table with the default plans added where their id is free."""
    missing = default_plans(existing.sparkSession).join(
        existing.select("plan_id"), "plan_id", "left_anti"
    )
    return existing.unionByName(missing)


def active_plans(plans: DataFrame) -> DataFrame:
    return plans.where("active").drop("active")


def plan_by_id(plans: DataFrame, plan_id: str) -> DataFrame:
    return plans.where(F.col("plan_id") == plan_id)


def customer_upsert(existing: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """Customers by unique email: known ones stay, new emails are added once.

    Of incoming rows with the same email the smallest name wins; the id derives
    from the email, so a repeated run creates the same customer.  An email is required:
    :func:`nameless_customers` are not added.
    """
    incoming = incoming.where(F.col("email").isNotNull())
    first = F.min_by(F.struct("name", "company", "phone"), F.struct("name", "company", "phone"))
    once = incoming.groupBy("email").agg(first.alias("_c"))
    new = once.join(existing.select("email"), "email", "left_anti").select(
        F.substring(F.sha2("email", 256), 1, 32).alias("customer_id"),
        "email",
        "_c.*",
        at.alias("created_at"),
        at.alias("updated_at"),
    )
    return existing.unionByName(new)


def nameless_customers(incoming: DataFrame) -> DataFrame:
    """The incoming customers that :func:`customer_upsert` rejects: those without an email."""
    return incoming.where(F.col("email").isNull())


def subscribe(requests: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New subscriptions, and the requests whose plan does not exist.

    ``requests`` is ``(subscription_id, customer_id, plan_id, start_date)``.
    Plans are unique by id, and one plan may be asked for by most requests.
    """
    days = F.lit(30)
    for cycle, length in CYCLE_DAYS.items():
        days = F.when(F.col("billing_cycle") == cycle, length).otherwise(days)
    terms = plans.select("plan_id", days.alias("_days"), "trial_days")
    joined = lookup_join(requests, terms, ["plan_id"])
    start = F.col("start_date")
    trial_end = F.when(
        F.col("trial_days") > 0, start + F.make_dt_interval(F.col("trial_days"))
    )
    created = joined.select(
        "subscription_id",
        "customer_id",
        "plan_id",
        F.when(F.col("trial_days") > 0, "trial").otherwise("active").alias("status"),
        "start_date",
        (start + F.make_dt_interval(F.col("_days"))).alias("end_date"),
        trial_end.alias("trial_end_date"),
        F.lit(True).alias("auto_renew"),
        start.alias("created_at"),
        start.alias("updated_at"),
    )
    rejected = lookup_join(requests, plans.select("plan_id"), ["plan_id"], "left_anti")
    return created, rejected


def active_subscription(subscriptions: DataFrame) -> DataFrame:
    """Newest active or trial subscription of each customer."""
    running = subscriptions.where(F.col("status").isin("active", "trial"))
    newest = [F.desc("created_at"), F.desc("subscription_id")]
    return newest_rows(running, ["customer_id"], newest)


def cancel_subscription(subscriptions: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """All subscriptions, the current one of each requesting customer cancelled."""
    ended = (
        active_subscription(subscriptions)
        .join(requests.select("customer_id").distinct(), "customer_id", "left_semi")
        .select("subscription_id", F.lit(True).alias("_ended"))
    )
    marked = subscriptions.join(ended, "subscription_id", "left")
    return marked.select(
        *[
            F.when(F.col("_ended"), F.lit("cancelled")).otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.when(F.col("_ended"), at).otherwise(F.col(c)).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in subscriptions.columns
        ]
    )


def invoice_create(requests: DataFrame) -> DataFrame:
    """Pending USD invoices, due 30 days after creation unless a date is given."""
    due = F.coalesce("due_date", F.col("created_at") + seconds_interval(30 * DAY))
    return requests.select(
        "invoice_id",
        "customer_id",
        "subscription_id",
        F.col("amount").cast("decimal(12,2)").alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit("pending").alias("status"),
        due.alias("due_date"),
        F.lit(None).cast("timestamp_ntz").alias("paid_date"),
        F.coalesce("description", F.lit("")).alias("description"),
        "created_at",
    )


def customer_invoices(invoices: DataFrame, customer_id: str | None = None) -> DataFrame:
    """Invoices of one customer, or of every customer in turn, newest first."""
    if customer_id is not None:
        invoices = invoices.where(F.col("customer_id") == customer_id)
    return invoices.orderBy("customer_id", F.desc("created_at"))


def payment_apply(invoices: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed payments with their customer, and the invoices they settle.

    A payment without invoice keeps an empty customer.  An invoice takes the
    time of its latest payment.
    """
    owners = invoices.select("invoice_id", "customer_id")
    booked = lookup_join(payments, owners, ["invoice_id"], "left").select(
        "payment_id",
        "invoice_id",
        F.coalesce("customer_id", F.lit("")).alias("customer_id"),
        F.col("amount").cast("decimal(12,2)").alias("amount"),
        F.lit("USD").alias("currency"),
        "method",
        F.lit("completed").alias("status"),
        "transaction_id",
        "processed_at",
    )
    latest = payments.groupBy("invoice_id").agg(F.max("processed_at").alias("_paid"))
    settled = invoices.join(latest, "invoice_id", "left").withColumns(
        {
            "status": F.when(F.col("_paid").isNotNull(), "completed").otherwise(F.col("status")),
            "paid_date": F.coalesce("_paid", "paid_date"),
        }
    )
    return booked, settled.drop("_paid")


def usage_stats(
    customers: DataFrame, subscriptions: DataFrame, plans: DataFrame, usage: DataFrame
) -> DataFrame:
    """Limits, use and next billing date per customer; an error text where there is none."""
    current = active_subscription(subscriptions).select(
        "customer_id",
        "subscription_id",
        "plan_id",
        F.col("end_date").alias("next_billing_date"),
        "auto_renew",
    )
    limits = plans.select(
        "plan_id", "max_prod", "max_nonprod", F.lit(True).alias("_planned")
    )
    with_plan = lookup_join(current, limits, ["plan_id"], "left")
    joined = customers.select("customer_id").join(with_plan, "customer_id", "left")
    joined = joined.join(usage, "customer_id", "left")
    error = F.when(F.col("subscription_id").isNull(), "no active subscription").when(
        F.col("_planned").isNull(), "plan not found"
    )
    return joined.select(
        "customer_id",
        "subscription_id",
        "plan_id",
        "prod_environments",
        "nonprod_environments",
        "max_prod",
        "max_nonprod",
        "next_billing_date",
        "auto_renew",
        error.alias("error"),
    )
