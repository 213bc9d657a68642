"""Access grants, checks, audit and compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timberflow.operators.secure import decrypt_rows


def current_grants(operations: DataFrame, seq: str = "seq") -> DataFrame:
    """Permissions in force per (user, resource) from a log of ``op`` rows: a
    grant replaces the list, a revoke removes the key. Only the latest
    operation counts, found with map-side combine."""
    return (
        operations.filter(F.col("op").isin("grant", "revoke"))
        .groupBy("user", "resource")
        .agg(F.max_by(F.struct("op", "permissions"), seq).alias("last"))
        .filter("last.op = 'grant'")
        .select("user", "resource", F.col("last.permissions").alias("permissions"))
    )


def check_access(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds ``access_granted``; no grant means no. The result is the audit log:
    every check is in it."""
    return (
        requests.join(grants, ["user", "resource"], "left")
        .withColumn("access_granted", F.coalesce(F.array_contains("permissions", F.col("action")), F.lit(False)))
        .drop("permissions")
    )


def audit_log(audit: DataFrame, user: str | None = None, limit: int = 1000, seq: str = "seq") -> DataFrame:
    """The last ``limit`` checks, oldest first, optionally of one user."""
    if user:
        audit = audit.filter(F.col("user") == user)
    return audit.orderBy(F.desc(seq)).limit(limit).orderBy(seq)


def compliance_report(audit: DataFrame, encryption_enabled: bool = True, key_present: bool = True) -> DataFrame:
    status = "compliant" if encryption_enabled and key_present else "non-compliant"
    return audit.agg(
        F.count("*").alias("total_access_attempts"),
        F.count_if(~F.col("access_granted")).alias("denied_attempts"),
        F.coalesce(F.try_divide(F.count_if("access_granted"), F.count("*")), F.lit(1.0)).alias("success_rate"),
    ).withColumn("compliance_status", F.lit(status))


def readable_logs(sealed: DataFrame, requests: DataFrame, grants: DataFrame, key: Column, schema: str) -> DataFrame:
    """Opened logs for the users who may read logs: ``log_id``, ``user`` and the
    columns of ``schema``; others get nothing. ``requests`` names a user and a
    ``log_id`` per row, ``sealed`` holds encrypted rows (``data``) by ``log_id``.

    Only rows that a granted request asks for are decrypted, after the joins. A
    wrong key or damaged data gives nulls; a repeated request is answered again.
    """
    allowed = grants.filter(
        (F.col("resource") == "logs") & F.array_contains("permissions", "read")
    ).select("user")
    granted = requests.select("log_id", "user").join(allowed, "user", "left_semi")
    return decrypt_rows(granted.join(sealed.select("log_id", "data"), "log_id"), key, schema, "log_id", "user")
