"""Anonymising, retention, export, erasure and encryption."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import lookup_join

PERSONAL_FIELDS = ["email", "phone", "name", "address"]
# Days each kind of data is kept, and the age at which personal data is
# anonymised (fixed values).
RETENTION_DAYS = {
    "usage_metrics": 365,
    "security_events": 2555,
    "billing_data": 2555,
    "code_analysis": 30,
}
ANONYMIZE_AFTER_DAYS = 90


def hashed_identifier(value: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(value, F.lit(salt)), 256), 1, 8)


def anonymize(
    df: DataFrame,
    salt: str = "default_salt",
    fields: Sequence[str] = PERSONAL_FIELDS,
    where: Column | None = None,
) -> DataFrame:
    """Replace the personal fields present by a short salted hash; null stays null.

    With ``where`` only the rows it holds for are changed.
    """
    changed = {}
    for field in df.schema.fields:
        if field.name in fields:
            value = F.col(field.name)
            nested = isinstance(field.dataType, (T.MapType, T.StructType, T.ArrayType))
            text = F.to_json(value) if nested else value.cast("string")
            hidden = hashed_identifier(text, salt)
            changed[field.name] = hidden if where is None else F.when(where, hidden).otherwise(text)
    return df.withColumns(changed)


def retention_action(
    data_type: str,
    ts: Column,
    as_of: Column,
    days: Mapping[str, int] = RETENTION_DAYS,
    anonymize_after: int = ANONYMIZE_AFTER_DAYS,
) -> Column:
    """purge, anonymize or keep, by age at ``as_of``."""
    kept = F.make_dt_interval(F.lit(days[data_type]))
    personal = F.make_dt_interval(F.lit(anonymize_after))
    return (
        F.when(ts < as_of - kept, "purge").when(ts < as_of - personal, "anonymize").otherwise("keep")
    )


def apply_retention(
    df: DataFrame, data_type: str, ts: str, as_of: Column, salt: str = "default_salt"
) -> DataFrame:
    """Rows that stay, with personal fields anonymised once old enough."""
    marked = df.withColumn("_action", retention_action(data_type, F.col(ts), as_of))
    staying = marked.where(F.col("_action") != "purge")
    return anonymize(staying, salt, where=F.col("_action") == "anonymize").drop("_action")


def user_export(requests: DataFrame, tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """All rows of the requested users as JSON ``(user_id, source, record)``.

    ``tables`` maps a source name to a table and its user column.
    """
    wanted = requests.select("user_id").distinct()
    parts = []
    for source, (df, user) in tables.items():
        record = F.to_json(F.struct(*df.columns))
        rows = df.select(
            F.col(user).alias("user_id"), F.lit(source).alias("source"), record.alias("record")
        )
        parts.append(lookup_join(rows, wanted, ["user_id"]))
    export = parts[0]
    for part in parts[1:]:
        export = export.unionByName(part)
    return export


def user_erase(df: DataFrame, user: str, requests: DataFrame) -> DataFrame:
    """The table without the rows of users that asked for erasure."""
    erased = requests.select(F.col("user_id").alias(user)).distinct()
    return lookup_join(df, erased, [user], "left_anti")


def erase_events(requests: DataFrame, at: Column) -> DataFrame:
    """Audit events of erasure requests."""
    return requests.select("user_id").distinct().select(
        F.concat(F.lit("erase-"), F.col("user_id").cast("string")).alias("event_id"),
        at.alias("ts"),
        F.lit("data_export").alias("event_type"),
        F.lit("info").alias("threat_level"),
        "user_id",
        F.concat(
            F.lit("Data erasure requested for user "), F.col("user_id").cast("string")
        ).alias("description"),
    )


def encrypt_columns(df: DataFrame, columns: Sequence[str], key: bytes) -> DataFrame:
    """Encrypt string columns with AES-GCM into base64; the key has 16, 24 or 32 bytes."""
    return df.withColumns({c: F.base64(F.aes_encrypt(F.col(c), F.lit(key))) for c in columns})


def decrypt_columns(df: DataFrame, columns: Sequence[str], key: bytes) -> DataFrame:
    """Undo :func:`encrypt_columns`; values that do not decrypt become null."""
    return df.withColumns(
        {c: F.try_aes_decrypt(F.unbase64(c), F.lit(key)).cast("string") for c in columns}
    )
