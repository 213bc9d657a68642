"""Access control, audit and encryption queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberflow.operators import access as AC, secure as SE
from timberflow.plans.registry import EVENT_LOGS, event_logs, micros, query, spread, table
from timberflow.plans.text_plans import _fields_sql, _mask_sql, _mask_steps

# A fixed key for the queries only; real keys come from the caller.
def _key():
    return F.unhex(F.lit("00112233445566778899aabbccddeeff"))


def operations(spark, sf_dir):
    """Events as grant operations: purchases and signups grant, errors revoke,
    the rest are checks."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(kind.isin("purchase", "signup"), "grant").when(kind == "error", "revoke").otherwise("check").alias("op"),
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("user"),
        F.when(F.col("user_id") % 3 == 0, "logs").otherwise("alerts").alias("resource"),
        F.when(kind == "purchase", F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("read"))).alias("permissions"),
        F.when(kind == "view", "read").otherwise("write").alias("action"),
    )


_OPS = """
WITH ops AS (SELECT event_id AS seq,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'grant' WHEN event_type = 'error' THEN 'revoke' ELSE 'check' END AS op,
  'u' || user_id % 50 AS "user", CASE WHEN user_id % 3 = 0 THEN 'logs' ELSE 'alerts' END AS resource,
  CASE WHEN event_type = 'purchase' THEN 'read,write' ELSE 'read' END AS permissions,
  CASE WHEN event_type = 'view' THEN 'read' ELSE 'write' END AS action FROM events),
grants AS (SELECT "user", resource, permissions FROM ops WHERE op <> 'check'
  QUALIFY row_number() OVER (PARTITION BY "user", resource ORDER BY seq DESC) = 1 AND op = 'grant'),
audit AS (SELECT seq, o."user", o.resource, action, coalesce(list_contains(string_split(g.permissions, ','), action), false) AS access_granted
  FROM ops o LEFT JOIN grants g ON o."user" = g."user" AND o.resource = g.resource WHERE op = 'check')"""


def _audit(spark, sf_dir):
    ops = operations(spark, sf_dir)
    return AC.check_access(ops.filter("op = 'check'").drop("op", "permissions"), AC.current_grants(ops))


@query("current_grants", _OPS + ' SELECT "user", resource, permissions FROM grants')
def current_grants(spark, sf_dir):
    grants = AC.current_grants(operations(spark, sf_dir))
    return grants.withColumn("permissions", F.array_join("permissions", ","))


@query("access_checks", _OPS + ' SELECT seq, "user", resource, action, access_granted FROM audit')
def access_checks(spark, sf_dir):
    return _audit(spark, sf_dir)


@query(
    "audit_log",
    _OPS + """ SELECT seq, resource, action, access_granted FROM audit WHERE "user" = 'u7' ORDER BY seq DESC LIMIT 1000""",
)
def audit_log(spark, sf_dir):
    return AC.audit_log(_audit(spark, sf_dir), "u7").drop("user")


@query(
    "compliance_report",
    _OPS
    + """ SELECT count(*) AS total_access_attempts, count(*) FILTER (NOT access_granted) AS denied_attempts,
  round(count(*) FILTER (access_granted) / count(*), 9) AS success_rate, 'compliant' AS compliance_status FROM audit""",
)
def compliance_report(spark, sf_dir):
    return AC.compliance_report(_audit(spark, sf_dir)).withColumn("success_rate", F.round("success_rate", 9))


@query("encrypt_roundtrip", "SELECT doc_id, md5(text) AS text_md5, true AS hidden FROM documents")
def encrypt_roundtrip(spark, sf_dir):
    """Encrypt each text, decrypt it again; the cipher text differs from it."""
    sealed = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", SE.encrypt_field(F.col("text"), _key()).alias("sealed")
    )
    return sealed.select(
        "doc_id",
        F.md5(SE.decrypt_field(F.col("sealed"), _key())).alias("text_md5"),
        (F.col("sealed") != F.col("text")).alias("hidden"),
    )


@query(
    "secure_logs",
    _mask_sql()
    + ", "
    + _fields_sql().removeprefix("WITH ")
    + """ SELECT doc_id AS log_id, md5(t8) AS message_md5, n AS sensitive_fields_detected
FROM m8 LEFT JOIN (SELECT doc_id, CAST(count(*) AS INT) AS n FROM f GROUP BY doc_id) USING (doc_id)""",
)
def secure_logs(spark, sf_dir):
    """Mask and encrypt every document, then open the rows again."""
    logs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("log_id"), F.col("text").alias("message"))
    sealed = SE.secure_logs(logs, _key(), F.lit("2024-01-31T00:00:00"), "log_id")
    opened = SE.decrypt_rows(sealed.select("log_id", "data"), _key(), "message string, sensitive_fields_detected int", "log_id")
    return opened.select("log_id", F.md5("message").alias("message_md5"), "sensitive_fields_detected")


@query(
    "readable_logs",
    _OPS
    + ","
    + EVENT_LOGS
    + ",\n"
    + _mask_steps("SELECT log_id AS doc_id, message AS t0 FROM logs")
    + """ SELECT log_id, 'u' || user_id % 50 AS "user", epoch_us(ts) AS ts_us, md5(t8) AS message_md5
FROM logs JOIN m8 ON log_id = doc_id
WHERE 'u' || user_id % 50 IN (SELECT "user" FROM grants WHERE resource = 'logs' AND list_contains(string_split(permissions, ','), 'read'))""",
)
def readable_logs(spark, sf_dir):
    """Logs are masked and encrypted; each user asks for those of the events
    they caused, and who may read them gets them opened."""
    logs = event_logs(spark, sf_dir).select("log_id", micros().alias("ts_us"), "message")
    sealed = SE.secure_logs(logs, _key(), F.lit("2024-01-31T00:00:00"), "log_id")
    requests = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("user"), F.col("event_id").alias("log_id")
    )
    grants = AC.current_grants(operations(spark, sf_dir))
    found = AC.readable_logs(sealed, requests, grants, _key(), "ts_us bigint, message string")
    return found.select("log_id", "user", "ts_us", F.md5("message").alias("message_md5"))
