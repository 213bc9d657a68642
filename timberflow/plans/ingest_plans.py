"""Source and sink queries: ingest forms, OTLP, files, queue, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberflow.plans.parse_plans import _BRACKETED, bracketed_lines
from timberflow.plans.registry import EVENT_LOGS, document_logs, event_logs, micros, query, table
from timberflow.session import workspace
from timberflow.sources import files as FI, otlp as OT, queue as QU, records as RE, sinks as SK


def _raw(spark, sf_dir):
    lines = bracketed_lines(spark, sf_dir).withColumn("record_id", F.col("log_id").cast("string"))
    return RE.raw_lines(lines.drop("log_id"))


@query(
    "ingest_raw_lines",
    _BRACKETED
    + """ SELECT sha256(CAST(log_id AS VARCHAR)) AS log_id,
  CASE event_type WHEN 'view' THEN 'structured_json' WHEN 'click' THEN 'raw_input' WHEN 'signup' THEN 'fallback_json' ELSE 'standard' END AS parser_type,
  CASE WHEN event_type IN ('error', 'purchase') THEN service_id || '-service' ELSE 'unknown_service' END AS service_id,
  CASE event_type WHEN 'view' THEN 'WARN' WHEN 'click' THEN 'INFO' WHEN 'signup' THEN 'INFO' ELSE level END AS level,
  CASE WHEN event_type IN ('click', 'signup') THEN NULL ELSE epoch_us(ts) // 1000000 * 1000000 END AS ts_us,
  value AS raw FROM lines""",
)
def ingest_raw_lines(spark, sf_dir):
    rows = RE.accepted(_raw(spark, sf_dir))
    return rows.select("log_id", "parser_type", "service_id", "level", micros().alias("ts_us"), "raw")


def records(spark, sf_dir):
    """Events as JSON records; clicks have a blank message and signups no
    service, so both are rejected."""
    kind = F.col("event_type")
    record = F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(" warning").alias("level"),
        F.when(kind == "error", F.col("service_id")).alias("service"),
        F.when(kind == "click", "  ").otherwise(F.concat(F.lit("mail u"), F.col("user_id").cast("string"), F.lit("@corp.example did "), "message")).alias("message"),
        F.lit("web-1").alias("host"),
        F.when(kind.isin("view", "purchase"), F.create_map(F.lit("service.name"), F.col("service_id"))).alias("metadata"),
        F.lit("prod").alias("environment"),
    )
    return event_logs(spark, sf_dir, costly=True).select(
        F.col("log_id").cast("string").alias("record_id"), F.to_json(record).alias("value")
    )


@query(
    "ingest_structured_records",
    f"""WITH {EVENT_LOGS} SELECT sha256(CAST(log_id AS VARCHAR)) AS log_id, service_id, service_id AS service, 'WARN' AS level, 'web-1' AS host,
  'prod' AS environment, 'mail [REDACTED:EMAIL] did ' || message AS message, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp,
  1 AS emails, true AS raw_is_clean FROM logs WHERE event_type NOT IN ('click', 'signup')""",
)
def ingest_structured_records(spark, sf_dir):
    rows = RE.accepted(RE.structured_records(records(spark, sf_dir)))
    return rows.select(
        "log_id",
        "service_id",
        "service",
        "level",
        "host",
        "environment",
        "message",
        "timestamp",
        F.col("redactions")["EMAIL"].alias("emails"),
        (~F.contains("raw", F.lit("@corp"))).alias("raw_is_clean"),
    )


@query(
    "rejected_records",
    f"""WITH {EVENT_LOGS} SELECT CAST(log_id AS VARCHAR) AS record_id, CASE event_type WHEN 'click' THEN 'Log message cannot be empty'
  ELSE 'service_id is required for structured log ingestion' END AS reject_reason FROM logs WHERE event_type IN ('click', 'signup')""",
)
def rejected_records(spark, sf_dir):
    return RE.rejects(RE.structured_records(records(spark, sf_dir))).select("record_id", "reject_reason")


def batches(spark, sf_dir):
    """Runs of 100 consecutive events as batch payloads."""
    rows = records(spark, sf_dir).withColumn("n", F.col("record_id").cast("bigint"))
    grouped = rows.groupBy(F.floor(F.col("n") / 100).cast("string").alias("record_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda e: e["value"]).alias("logs")
    )
    return grouped.select("record_id", F.concat(F.lit('{"logs":['), F.array_join("logs", ","), F.lit("]}")).alias("value"))


@query(
    "batch_ingest_report",
    f"""WITH {EVENT_LOGS}, b AS (SELECT *, CAST(log_id // 100 AS VARCHAR) AS batch_id, event_type IN ('click', 'signup') AS failed FROM logs)
SELECT batch_id, count(*) FILTER (NOT failed) AS processed_records, count(*) FILTER (failed) AS failed_records,
  CASE WHEN bool_or(failed) THEN 'partial_success' ELSE 'success' END AS status, count(*) FILTER (NOT failed) AS emails,
  CAST(min(log_id % 100) FILTER (failed) AS INT) AS first_failure FROM b GROUP BY batch_id""",
)
def batch_ingest_report(spark, sf_dir):
    unpacked = RE.batch_records(batches(spark, sf_dir))
    report = RE.batch_report(RE.structured_records(unpacked))
    return report.select(
        "batch_id",
        "processed_records",
        "failed_records",
        "status",
        F.col("redaction_summary")["EMAIL"].alias("emails"),
        F.try_element_at("failures", F.lit(1))["record_index"].alias("first_failure"),
    )


def payloads(spark, sf_dir):
    """One payload per event in the form its type picks."""
    kind, message = F.col("event_type"), F.col("message")
    value = (
        F.when(kind == "error", F.to_json(F.struct(F.lit("svc-x").alias("service_id"), message.alias("message"), F.col("user_id").alias("user"))))
        .when(kind == "view", F.to_json(F.struct(message.alias("log_data"), F.col("service_id"))))
        .when(kind == "click", F.concat(F.lit('{"logs":[{"service":"svc-b","message":"'), F.col("user_id").cast("string"), F.lit('"},{"message":"m"}]}')))
        .when(kind == "signup", F.lit('{"logs":[],"log_data":"x"}'))
        .otherwise(F.lit("no json"))
    )
    return event_logs(spark, sf_dir, costly=True).select(F.col("log_id").cast("string").alias("record_id"), value.alias("value"))


@query(
    "payload_forms",
    """SELECT CASE event_type WHEN 'error' THEN 'structured' WHEN 'view' THEN 'raw' WHEN 'click' THEN 'batch' WHEN 'signup' THEN 'ambiguous'
  ELSE 'invalid' END AS form, count(*) AS payloads FROM events GROUP BY 1""",
)
def payload_forms(spark, sf_dir):
    return RE.payload_form(payloads(spark, sf_dir)).groupBy("form").agg(F.count("*").alias("payloads"))


@query(
    "ingest_payloads",
    f"""WITH {EVENT_LOGS}, o AS (
  SELECT event_type, service_id, message, CAST(user_id AS VARCHAR) AS user_key FROM logs)
SELECT parser_type, service_id, reject_reason, count(*) AS rows FROM (
  SELECT 'structured_input' AS parser_type, 'svc-x' AS service_id, NULL AS reject_reason FROM o WHERE event_type = 'error'
  UNION ALL SELECT 'raw_input', service_id, NULL FROM o WHERE event_type = 'view'
  UNION ALL SELECT 'structured_input', 'svc-b', NULL FROM o WHERE event_type = 'click'
  UNION ALL SELECT 'structured_input', NULL, 'service_id is required for structured log ingestion' FROM o WHERE event_type = 'click'
  UNION ALL SELECT NULL, NULL, 'Ambiguous payload: cannot contain both ''logs'' and ''log_data''' FROM o WHERE event_type = 'signup'
  UNION ALL SELECT NULL, NULL, 'not a JSON object' FROM o WHERE event_type = 'purchase') GROUP BY ALL""",
)
def ingest_payloads(spark, sf_dir):
    rows = RE.ingest_payloads(payloads(spark, sf_dir))
    return rows.groupBy("parser_type", "service_id", "reject_reason").agg(F.count("*").alias("rows"))


def otlp_payloads(spark, sf_dir):
    """Runs of 50 events as OTLP payloads, one resource per event."""
    kind = F.col("event_type")
    attribute = lambda key, value: F.concat(F.lit(f'{{"key":"{key}","value":{{"stringValue":"'), value, F.lit('"}}'))
    record = F.concat(
        F.lit('{"timeUnixNano":"'),
        F.when(kind == "view", "").otherwise((F.unix_millis(F.col("ts").cast("timestamp")) * 1_000_000).cast("string")),
        F.lit('","severityText":"'),
        F.when(kind == "click", " notice ").otherwise(""),
        F.lit('","severityNumber":'),
        (F.col("user_id") % 26).cast("string"),
        F.lit(',"body":'),
        F.when(kind == "purchase", F.lit('{"kvlistValue":{"values":[{"key":"n","value":{"intValue":"7"}},{"key":"ok","value":{"boolValue":true}}]}}'))
        .when(kind == "error", F.concat(F.lit('{"stringValue":"[2024-01-01 00:00:00] ERROR: '), "service_id", F.lit('-service down"}')))
        .otherwise(F.concat(F.lit('{"stringValue":"text '), F.col("user_id").cast("string"), F.lit('"}'))),
        F.lit(',"attributes":['),
        attribute("env", F.lit("staging")),
        F.lit(',{"key":"sizes","value":{"arrayValue":{"values":[{"intValue":"1"},{"doubleValue":2.5}]}}}]}'),
    )
    resource = F.concat(
        F.lit('{"resource":{"attributes":['),
        attribute("service.name", F.col("service_id")),
        F.lit(","),
        attribute("env", F.lit("production")),
        F.lit(","),
        attribute("log", F.col("log_id").cast("string")),
        F.lit(']},"scopeLogs":[{"logRecords":['),
        record,
        F.lit(',"not an object"]},7]}'),
    )
    rows = event_logs(spark, sf_dir, costly=True).select("log_id", resource.alias("resource"))
    return rows.groupBy(F.floor(F.col("log_id") / 50).cast("string").alias("record_id")).agg(
        F.concat(F.lit('{"resourceLogs":['), F.array_join(F.collect_list("resource"), ","), F.lit(',null,"x"]}')).alias("value")
    )


_NUMBER_LEVEL = """CASE WHEN user_id % 26 BETWEEN 1 AND 4 THEN 'TRACE' WHEN user_id % 26 BETWEEN 5 AND 8 THEN 'DEBUG'
  WHEN user_id % 26 BETWEEN 13 AND 16 THEN 'WARN' WHEN user_id % 26 BETWEEN 17 AND 20 THEN 'ERROR'
  WHEN user_id % 26 BETWEEN 21 AND 24 THEN 'FATAL' ELSE 'INFO' END"""


@query(
    "otlp_flatten",
    f"""WITH {EVENT_LOGS} SELECT log_id, CASE event_type WHEN 'error' THEN '2024-01-01T00:00:00' WHEN 'view' THEN 'LATER' ELSE
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) // 1000 % 1000 = 0 THEN '' ELSE strftime(ts, '.%g') || '000' END || 'Z' END AS timestamp,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'NOTICE' WHEN 'purchase' THEN 'INFO' ELSE {_NUMBER_LEVEL} END AS level,
  CASE event_type WHEN 'error' THEN service_id || '-service down' WHEN 'purchase' THEN '{{"n":7,"ok":true}}' ELSE 'text ' || user_id END AS message,
  CASE event_type WHEN 'error' THEN 'standard' WHEN 'purchase' THEN 'structured_json' ELSE 'otlp_log' END AS parser_type,
  CASE event_type WHEN 'error' THEN service_id || '-service' ELSE service_id END AS service_id, 'staging' AS env, '[1,2.5]' AS sizes FROM logs""",
)
def otlp_flatten(spark, sf_dir):
    rows = OT.otlp_logs(otlp_payloads(spark, sf_dir), F.lit("LATER"))
    kv = lambda key: F.try_element_at("metadata_kv", F.lit(key))
    return rows.select(
        kv("log").cast("bigint").alias("log_id"),
        "timestamp",
        "level",
        "message",
        "parser_type",
        kv("service").alias("service_id"),
        kv("env").alias("env"),
        kv("sizes").alias("sizes"),
    )


@query(
    "json_file_lines",
    """SELECT event_id AS log_id, epoch_us(date_trunc('second', ts)) AS ts_us, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' END AS severity,
  CASE WHEN event_type = 'signup' THEN 'plain ' || event_id ELSE 'm' || event_id END AS body FROM events WHERE event_type <> 'signup'
UNION ALL SELECT event_id, NULL, NULL, 'plain ' || event_id FROM events WHERE event_type = 'signup'""",
)
def json_file_lines(spark, sf_dir):
    kind = F.col("event_type")
    as_json = F.to_json(
        F.struct(
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.when(kind == "error", "ERROR").when(kind == "view", "debug").otherwise("other").alias("level"),
            F.concat(F.lit("m"), F.col("log_id").cast("string")).alias("message"),
        )
    )
    plain = F.concat(F.lit("plain "), F.col("log_id").cast("string"))
    lines = event_logs(spark, sf_dir).select("log_id", F.when(kind == "signup", plain).otherwise(as_json).alias("value"))
    return FI.json_lines(lines).select("log_id", micros().alias("ts_us"), "severity", "body")


@query(
    "syslog_file_lines",
    """SELECT event_id AS log_id, epoch_us(date_trunc('second', ts)) AS ts_us, 'host' || user_id % 9 AS hostname,
  CASE WHEN event_type = 'view' THEN NULL ELSE 'app' END AS service, CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS pid,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' END AS severity,
  CASE event_type WHEN 'error' THEN 'it failed: error' WHEN 'purchase' THEN 'a Warning' ELSE 'fine' END AS body FROM events""",
)
def syslog_file_lines(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id")
    line = F.concat(
        F.date_format(F.col("ts").cast("timestamp"), "MMM d HH:mm:ss"),
        F.lit(" host"),
        (user % 9).cast("string"),
        F.when(kind == "view", " ").when(kind == "click", F.concat(F.lit(" app["), user.cast("string"), F.lit("]: "))).otherwise(" app: "),
        F.when(kind == "error", "it failed: error").when(kind == "purchase", "a Warning").otherwise("fine"),
    )
    parsed = FI.syslog_lines(event_logs(spark, sf_dir).select("log_id", line.alias("value")), 2024)
    kv = lambda key: F.try_element_at("attributes", F.lit(key)).alias(key)
    return parsed.select("log_id", micros().alias("ts_us"), kv("hostname"), kv("service"), kv("pid"), "severity", "body")


@query(
    "collector_service_name",
    f"""WITH {EVENT_LOGS} SELECT log_id, CASE event_type WHEN 'error' THEN service_id WHEN 'view' THEN 'app' ELSE 'host-syslog' END AS service_name FROM logs""",
)
def collector_service_name(spark, sf_dir):
    kind = F.col("event_type")
    attributes = F.map_filter(
        F.create_map(
            F.lit("service_id"), F.when(kind == "error", F.col("service_id")), F.lit("service"), F.when(kind.isin("error", "view"), "app")
        ),
        lambda _k, v: v.isNotNull(),
    )
    return event_logs(spark, sf_dir).select("log_id", FI.service_name(attributes).alias("service_name"))


def queue_rows(spark, sf_dir):
    kind, message = F.col("event_type"), F.col("message")
    value = (
        F.when(
            kind == "error",
            F.to_json(
                F.struct(
                    F.struct("message", "level", F.lit("standard").alias("parser_type"), F.create_map(F.lit("a"), F.lit("1")).alias("metadata")).alias("parsed"),
                    F.create_map(F.lit("service"), F.col("service_id")).alias("metadata"),
                )
            ),
        )
        .when(kind == "view", F.to_json(F.struct(F.struct(F.lit("svc-q").alias("service"), message.alias("msg")).alias("parsed"))))
        .when(kind == "purchase", F.lit('{"invalid": 1}'))
        .when(kind == "click", F.lit("  "))
        .otherwise(F.concat(F.lit("{"), message))
    )
    return event_logs(spark, sf_dir, costly=True).select(F.col("log_id").alias("key"), value.alias("value"))


@query(
    "dead_letters",
    """SELECT CASE WHEN event_type IN ('error', 'view') THEN 'processed_logs' WHEN event_type = 'signup' THEN 'failed_logs'
  ELSE 'malformed_payloads' END AS outcome, count(*) AS payloads FROM events GROUP BY 1""",
)
def dead_letters(spark, sf_dir):
    return QU.outcome_counts(QU.classify_payloads(queue_rows(spark, sf_dir)))


@query(
    "queue_logs",
    f"""WITH {EVENT_LOGS} SELECT CAST(log_id AS VARCHAR) AS log_id, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'UNKNOWN' END AS level, message,
  CASE event_type WHEN 'error' THEN service_id ELSE 'svc-q' END AS service_id,
  CASE event_type WHEN 'error' THEN 'standard' ELSE 'unknown' END AS parser_type FROM logs WHERE event_type IN ('error', 'view')""",
)
def queue_logs(spark, sf_dir):
    rows = QU.payload_logs(QU.classify_payloads(queue_rows(spark, sf_dir)))
    return rows.select("log_id", "level", "message", "service_id", "parser_type")


_NOW = "timestamp_ntz'2024-01-20 00:00:00'"


@query(
    "retention_filter",
    f"""WITH {EVENT_LOGS} SELECT log_id, epoch_us(ts) AS ts_us FROM logs WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL '168 hours'""",
)
def retention_filter(spark, sf_dir):
    kept = SK.retained(event_logs(spark, sf_dir), F.expr(_NOW))
    return kept.select("log_id", micros().alias("ts_us"))


@query(
    "expired_days",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-13' GROUP BY 1""",
)
def expired_days(spark, sf_dir):
    archive = event_logs(spark, sf_dir).withColumn("day", F.to_date("ts"))
    days = SK.expired_days(archive, F.expr(_NOW))
    return days.withColumn("day", F.col("day").cast("string"))


@query(
    "dual_export",
    """SELECT count(*) AS archived, count(DISTINCT source || chr(31) || text) AS indexed FROM documents""",
)
def dual_export(spark, sf_dir):
    """Every log goes to the archive, only first copies to the index; both are
    counted from what was written."""
    logs = document_logs(spark, sf_dir)
    folder = workspace(spark, "export")
    for _ in range(2):  # a repeated batch replaces its folder
        SK.write_archive(logs.withColumn("ts", F.timestamp_seconds("log_id")), f"{folder}/archive", batch=0)
    copies = logs.withColumn("log_id", F.sha2(F.concat_ws("\x1f", "service_id", "message"), 256))
    SK.write_new_logs(copies, f"{folder}/index")
    SK.write_new_logs(copies, f"{folder}/index")  # a repeated write adds nothing
    archived, indexed = (SK.read_table(spark, f"{folder}/{name}").agg(F.count("*")) for name in ("archive", "index"))
    return archived.toDF("archived").withColumn("indexed", indexed.scalar())
