"""Field and row encryption (AES-GCM). Keys belong to the caller: pass a
column with the 16, 24 or 32 key bytes, for instance from a secret store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timberflow.functions.redact import mask_sensitive, sensitive_fields
from timberflow.operators.pinning import pin

ALGORITHM = "AES-GCM"


def encrypt_field(column: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(column.cast("string"), key, F.lit("GCM")))


def decrypt_field(column: Column, key: Column) -> Column:
    """Null for a wrong key or a damaged value."""
    return F.try_aes_decrypt(F.unbase64(column), key, F.lit("GCM")).cast("string")


def encrypt_rows(df: DataFrame, key: Column, at: Column, *keep: str) -> DataFrame:
    """Each row as one encrypted JSON text. ``at`` is the time to record;
    ``keep`` columns stay readable, for partitioning and joins."""
    return df.select(
        *keep,
        F.lit(True).alias("encrypted"),
        F.lit(ALGORITHM).alias("algorithm"),
        encrypt_field(F.to_json(F.struct("*")), key).alias("data"),
        at.alias("timestamp"),
    )


def decrypt_rows(df: DataFrame, key: Column, schema: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.from_json(decrypt_field(F.col("data"), key), schema).alias("row")).select(*keep, "row.*")


def secure_logs(logs: DataFrame, key: Column, at: Column, *keep: str) -> DataFrame:
    """Mask the message, record how many sensitive fields it held, encrypt the
    row."""
    found = F.size(sensitive_fields(F.col("message")))
    scanned = pin(logs, {"__found": found, "__masked": mask_sensitive(F.col("message"))})
    masked = scanned.withColumns(
        {"sensitive_fields_detected": F.nullif(F.col("__found"), F.lit(0)), "message": F.col("__masked")}
    ).drop("__found", "__masked")
    return encrypt_rows(masked, key, at, *keep)
