"""Licence keys, entitlements, status and feature access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import lookup_join
from ..functions.text import hmac_sha256

KEY_PATTERN = r"\A(TRIAL|STARTUP|ENTERPRISE)((?s).{8})\s*([+-]?\d+)\s*\z"
KEY_MAX_AGE_SECONDS = 2_592_000

# Key prefix -> features, production and other environments, days valid (fixed values).
ENTITLEMENTS = {
    "TRIAL": (["basic_analysis", "basic_testing"], 1, 1, 30),
    "STARTUP": (["basic_analysis", "basic_testing", "advanced_metrics"], 1, 2, 365),
    "ENTERPRISE": (
        [
            "basic_analysis",
            "basic_testing",
            "advanced_metrics",
            "security_analysis",
            "custom_reports",
        ],
        3,
        5,
        365,
    ),
}


def license_keys_parse(keys: DataFrame, as_of_seconds: Column) -> DataFrame:
    """Plan, signature and time of each key; null columns where it is not acceptable."""
    key = F.col("license_key")
    issued = F.regexp_extract(key, KEY_PATTERN, 3).try_cast("bigint")
    fine = issued.isNotNull() & (as_of_seconds - issued <= KEY_MAX_AGE_SECONDS)
    return keys.select(
        "*",
        F.when(fine, F.lower(F.regexp_extract(key, KEY_PATTERN, 1))).alias("plan_id"),
        F.when(fine, F.regexp_extract(key, KEY_PATTERN, 2)).alias("signature"),
        F.when(fine, issued).alias("issued_seconds"),
    )


def license_keys_issue(subscriptions: DataFrame, secret: str, seconds: Column) -> DataFrame:
    """A signed key per subscription: plan, 8 hex digits of the keyed hash, issue time."""
    at = seconds.cast("string")
    message = F.concat_ws(":", F.col("customer_id").cast("string"), "plan_id", at)
    signature = F.substring(hmac_sha256(secret, message), 1, 8)
    return subscriptions.withColumn(
        "license_key", F.concat(F.upper("plan_id"), signature, at)
    )


def license_entitlements(keys: DataFrame, as_of: Column) -> DataFrame:
    """Licence terms by key prefix; keys with another prefix are invalid."""
    chosen = F.lit(None).cast(
        "struct<license_type:string,features:array<string>,max_prod:int,max_nonprod:int,days:int>"
    )
    for prefix, (features, prod, nonprod, days) in ENTITLEMENTS.items():
        terms = F.struct(
            F.lit(prefix.lower()).alias("license_type"),
            F.array(*[F.lit(f) for f in features]).alias("features"),
            F.lit(prod).alias("max_prod"),
            F.lit(nonprod).alias("max_nonprod"),
            F.lit(days).alias("days"),
        )
        chosen = F.when(F.col("license_key").startswith(prefix), terms).otherwise(chosen)
    named = keys.withColumn("_t", chosen)
    return named.select(
        *keys.columns,
        F.col("_t").isNotNull().alias("valid"),
        "_t.license_type",
        "_t.features",
        "_t.max_prod",
        "_t.max_nonprod",
        F.when(F.col("_t").isNotNull(), as_of).alias("issued_at"),
        (as_of + F.make_dt_interval(F.col("_t.days"))).alias("expires_at"),
    )


def license_status(licenses: DataFrame, activations: DataFrame, as_of: Column) -> DataFrame:
    """Status of each activation ``(activation_id, license_id, fingerprint)``.

    Invalid without a licence or with another fingerprint; expired once past its
    end; valid otherwise, also without an end.
    """
    terms = licenses.select(
        "license_id",
        "license_type",
        "expires_at",
        F.col("fingerprint").alias("_print"),
        F.lit(True).alias("_known"),
    )
    joined = lookup_join(activations, terms, ["license_id"], "left")
    ended = F.coalesce(as_of > F.col("expires_at"), F.lit(False))
    status = (
        F.when(F.col("_known").isNull() | ~F.col("_print").eqNullSafe(F.col("fingerprint")), "invalid")
        .when(ended & (F.col("license_type") == "trial"), "trial_expired")
        .when(ended, "expired")
        .otherwise("valid")
    )
    return joined.select("activation_id", "license_id", status.alias("status"))


def feature_access(customers: DataFrame, licenses: DataFrame, feature: str) -> DataFrame:
    """Whether each customer's licence lists the feature; false without a licence."""
    owned = licenses.groupBy("customer_id").agg(
        F.bool_or(F.array_contains("features", feature)).alias("_has")
    )
    return customers.join(owned, "customer_id", "left").select(
        "customer_id", F.coalesce("_has", F.lit(False)).alias("access")
    )
