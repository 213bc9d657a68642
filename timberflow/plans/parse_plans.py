"""Parsing queries over log lines written from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberflow.operators import parsing as P
from timberflow.plans.registry import EVENT_LOGS, event_logs, query, spread, table


def bracketed_lines(spark, sf_dir):
    """``[time] LEVEL: message`` per event; views are JSON, clicks are not in
    any known form."""
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    text = F.concat(
        F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "level", F.lit(": "), "service_id",
        F.lit("-service "), "message",
    )
    as_json = F.to_json(
        F.struct(
            F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.lit("warning").alias("level"),
            F.col("message"),
            F.col("user_id").alias("user"),
        )
    )
    line = (
        F.when(kind == "view", as_json)
        .when(kind == "click", F.concat(F.lit("click "), "message"))
        .when(kind == "signup", F.concat(F.lit("{"), "message", F.lit("}")))
        .otherwise(text)
    )
    return event_logs(spark, sf_dir, costly=True).select("log_id", line.alias("value"))


_BRACKETED = f"""
WITH {EVENT_LOGS},
lines AS (SELECT * EXCLUDE (value), CASE event_type
  WHEN 'view' THEN '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","level":"warning","message":' || to_json(message) || ',"user":' || user_id || '}}'
  WHEN 'click' THEN 'click ' || message
  WHEN 'signup' THEN '{{' || message || '}}'
  ELSE '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || level || ': ' || service_id || '-service ' || message END AS value
  FROM logs)"""


@query(
    "parse_lines",
    _BRACKETED
    + """,
r AS (SELECT *, regexp_extract(value, '^\\[(.*?)\\]\\s+(?i:INFO|WARN|WARNING|ERROR|DEBUG|CRITICAL):\\s+(.*)$', 1) AS stamp FROM lines)
SELECT log_id,
  CASE event_type WHEN 'view' THEN 'structured_json' WHEN 'click' THEN NULL WHEN 'signup' THEN 'fallback_json' ELSE 'standard' END AS parser_type,
  CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 'click' THEN NULL WHEN 'signup' THEN ''
    ELSE replace(stamp, ' ', 'T') END AS timestamp,
  CASE event_type WHEN 'view' THEN 'WARN' WHEN 'click' THEN NULL WHEN 'signup' THEN 'INFO' ELSE level END AS level,
  CASE event_type WHEN 'view' THEN message WHEN 'click' THEN NULL WHEN 'signup' THEN value ELSE service_id || '-service ' || message END AS message,
  CASE WHEN event_type IN ('error', 'purchase') THEN service_id || '-service' END AS service,
  CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END AS user_key,
  CASE WHEN event_type <> 'click' THEN value END AS raw
FROM r""",
)
def parse_lines(spark, sf_dir):
    parsed = P.parse_lines(bracketed_lines(spark, sf_dir))
    return parsed.select(
        "log_id",
        "parser_type",
        "timestamp",
        "level",
        "message",
        F.try_element_at("metadata_kv", F.lit("service")).alias("service"),
        F.try_variant_get("metadata", "$.user", "string").alias("user_key"),
        "raw",
    )


@query(
    "parser_metrics",
    _BRACKETED
    + """ SELECT count(*) FILTER (event_type <> 'click') AS parsed_logs,
  count(*) FILTER (event_type IN ('click', 'signup')) AS failed_logs,
  count(*) FILTER (event_type = 'view') AS structured_json_logs,
  count(*) FILTER (event_type IN ('error', 'purchase', 'signup')) AS standard_logs,
  0::BIGINT AS timestamp_failures, 0::BIGINT AS empty_logs FROM lines""",
)
def parser_metrics(spark, sf_dir):
    return P.parser_metrics(P.parse_lines(bracketed_lines(spark, sf_dir)))


@query(
    "parse_document_lines",
    """SELECT CASE WHEN regexp_matches(trim(line, e' \\t\\n\\r\\f'), '^\\{.*\\}$') THEN 'braced'
  WHEN regexp_matches(trim(line, e' \\t\\n\\r\\f'), '(?i)^\\[(.*?)\\]\\s+(INFO|WARN|WARNING|ERROR|DEBUG|CRITICAL):\\s+(.*)$') THEN 'standard'
  WHEN trim(line, e' \\t\\n\\r\\f') = '' THEN 'empty' ELSE 'none' END AS form, count(*) AS lines
FROM (SELECT unnest(string_split(text, e'\\n')) AS line FROM documents) GROUP BY 1""",
)
def parse_document_lines(spark, sf_dir):
    """Every line of every document through the strict parser."""
    lines = spread(table(spark, sf_dir, "documents")).select(F.explode(F.split("text", "\n", -1)).alias("value"))
    form = (
        F.when(F.col("parser_type").isin("structured_json", "fallback_json"), "braced")
        .when(F.col("parser_type") == "standard", "standard")
        .when(F.col("is_empty"), "empty")
        .otherwise("none")
    )
    return P.parse_lines(lines).groupBy(form.alias("form")).agg(F.count("*").alias("lines"))


def mixed_lines(spark, sf_dir):
    """One line per event in the form its type picks: JSON, access log, syslog,
    ISO with level, or key=value text."""
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    user = F.col("user_id").cast("string")
    line = (
        F.when(
            kind == "error",
            F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" [error] "), "service_id", F.lit(" "), "message"),
        )
        .when(
            kind == "view",
            F.concat(
                F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" - u"), user, F.lit(" ["),
                F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss +0000"), F.lit('] "GET /p/'), user,
                F.lit(' HTTP/1.1" 200 '), F.length("message").cast("string"), F.lit(' "-" "agent 1"'),
            ),
        )
        .when(
            kind == "purchase",
            F.concat(F.date_format(ts, "MMM dd HH:mm:ss"), F.lit(" host"), user, F.lit(" shop["), user, F.lit("]: "), "message"),
        )
        .when(kind == "signup", F.to_json(F.struct(F.lit("notice").alias("level"), "message", F.col("user_id").alias("user"))))
        .otherwise(F.concat(F.lit("clicked by user="), user, F.lit(" in="), "service_id"))
    )
    return event_logs(spark, sf_dir, costly=True).select("log_id", line.alias("value"))


_PATTERNS = {fmt.name: fmt.pattern.replace("'", "''") for fmt in P.BUILTIN_FORMATS}
_MIXED = f"""
WITH {EVENT_LOGS},
lines AS (SELECT * EXCLUDE (value), CASE event_type
  WHEN 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ' [error] ' || service_id || ' ' || message
  WHEN 'view' THEN '10.0.0.' || user_id % 250 || ' - u' || user_id || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') || '] "GET /p/'
    || user_id || ' HTTP/1.1" 200 ' || length(message) || ' "-" "agent 1"'
  WHEN 'purchase' THEN strftime(ts, '%b %d %H:%M:%S') || ' host' || user_id || ' shop[' || user_id || ']: ' || message
  WHEN 'signup' THEN '{{"level":"notice","message":' || to_json(message) || ',"user":' || user_id || '}}'
  ELSE 'clicked by user=' || user_id || ' in=' || service_id END AS value FROM logs),
j AS (SELECT *, event_type = 'signup' AS is_json FROM lines),
w AS (SELECT *, CASE WHEN is_json THEN 'json'
  WHEN regexp_matches(value, '{_PATTERNS["apache_combined"]}') THEN 'apache_combined'
  WHEN regexp_matches(value, '{_PATTERNS["syslog"]}') THEN 'syslog'
  WHEN regexp_extract(value, '{_PATTERNS["iso8601_structured"]}', 4) <> '' THEN 'iso8601_structured'
  WHEN regexp_matches(value, '{_PATTERNS["kubernetes"]}') THEN 'kubernetes'
  WHEN regexp_extract(value, '{_PATTERNS["generic_timestamp_level"]}', 3) <> '' THEN 'generic_timestamp_level'
  WHEN regexp_extract(value, '{_PATTERNS["key_value"]}', 1) <> '' THEN 'key_value'
  ELSE 'plain_text' END AS parser_used FROM j),
p AS (SELECT *, CASE WHEN is_json THEN 1.0 WHEN parser_used IN ('apache_combined', 'syslog', 'iso8601_structured', 'kubernetes') THEN 0.75 ELSE 0.5 END AS coverage FROM w)"""


def multi_parsed(spark, sf_dir):
    return P.parse_multi_format(mixed_lines(spark, sf_dir))


@query(
    "parse_multi_format",
    _MIXED
    + f""" SELECT log_id, parser_used, CAST(coverage AS DOUBLE) AS coverage, true AS success,
  CASE WHEN is_json THEN 'NOTICE' WHEN parser_used = 'iso8601_structured' THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE WHEN is_json THEN message WHEN parser_used = 'iso8601_structured' THEN regexp_extract(value, '{_PATTERNS["iso8601_structured"]}', 4)
       WHEN parser_used = 'key_value' THEN regexp_extract(value, '{_PATTERNS["key_value"]}', 1) ELSE value END AS message,
  CASE parser_used WHEN 'syslog' THEN regexp_extract(value, '{_PATTERNS["syslog"]}', 1) WHEN 'apache_combined' THEN regexp_extract(value, '{_PATTERNS["apache_combined"]}', 4)
       WHEN 'iso8601_structured' THEN regexp_extract(value, '{_PATTERNS["iso8601_structured"]}', 1) END AS captured_timestamp,
  CASE parser_used WHEN 'apache_combined' THEN regexp_extract(value, '{_PATTERNS["apache_combined"]}', 6) END AS path
FROM p""",
)
def parse_multi_format(spark, sf_dir):
    return multi_parsed(spark, sf_dir).select(
        "log_id",
        "parser_used",
        "coverage",
        "success",
        "level",
        "message",
        "captured_timestamp",
        F.try_element_at("metadata_kv", F.lit("path")).alias("path"),
    )


@query(
    "parse_statistics",
    _MIXED
    + """ SELECT count(*) AS total_attempted, count(*) FILTER (coverage = 1) AS successfully_parsed,
  count(*) FILTER (coverage >= 0.5 AND coverage < 1) AS partially_parsed, count(*) FILTER (coverage < 0.5) AS failed,
  count(*) FILTER (coverage = 1) / count(*) AS success_rate FROM p""",
)
def parse_statistics(spark, sf_dir):
    return P.parse_statistics(multi_parsed(spark, sf_dir))


@query(
    "parser_health",
    _MIXED
    + """ SELECT 'degraded' AS status, count(*) FILTER (coverage = 1) / count(*) AS success_rate,
  count(*) AS total_logs_processed FROM p""",
)
def parser_health(spark, sf_dir):
    return P.parser_health(P.parse_statistics(multi_parsed(spark, sf_dir)))


def _counted(where: str) -> str:
    rows = [
        f"SELECT '{fmt.name}' AS name, {fmt.priority} AS priority, count(*) FILTER ({where}"
        f"regexp_matches(value, '{_PATTERNS[fmt.name]}')) AS matches FROM p"
        for fmt in P.BUILTIN_FORMATS
    ]
    return _MIXED + ", f AS (" + " UNION ALL ".join(rows) + ")"


@query("format_coverage", _counted("NOT is_json AND ") + " SELECT * FROM f")
def format_coverage(spark, sf_dir):
    return P.format_coverage(multi_parsed(spark, sf_dir)).drop("position")


@query(
    "suggest_format",
    _counted("") + " SELECT 'key_value' AS suggested_pattern, matches, (SELECT count(*) FROM p) AS lines FROM f WHERE name = 'key_value'",
)
def suggest_format(spark, sf_dir):
    return P.suggest_format(mixed_lines(spark, sf_dir))


@query(
    "batch_parse_report",
    _MIXED
    + """ SELECT count(*) AS total_lines, count(*) AS successfully_parsed, 0::BIGINT AS failed_to_parse, 1.0::DOUBLE AS success_rate,
  (SELECT string_agg(parser_used || '=' || n, ',' ORDER BY parser_used) FROM (SELECT parser_used, count(*) AS n FROM p GROUP BY 1)) AS parser_usage FROM p""",
)
def batch_parse_report(spark, sf_dir):
    report = P.batch_report(multi_parsed(spark, sf_dir))
    usage = F.transform(F.map_entries("parser_usage"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return report.withColumn("parser_usage", F.array_join(usage, ","))


@query("parser_usage", _MIXED + " SELECT parser_used, count(*) AS lines FROM p GROUP BY 1")
def parser_usage(spark, sf_dir):
    return P.parser_usage(multi_parsed(spark, sf_dir))


@query(
    "sample_analysis",
    _MIXED + " SELECT log_id, substr(value, 1, 100) AS line, true AS success, parser_used, CAST(coverage AS DOUBLE) AS coverage FROM p",
)
def sample_analysis(spark, sf_dir):
    return P.sample_analysis(multi_parsed(spark, sf_dir), "value", "log_id")


@query(
    "custom_format_parse",
    _MIXED
    + """ SELECT log_id, CASE WHEN event_type = 'click' THEN 'clicks' ELSE parser_used END AS parser_used,
  CAST(CASE WHEN event_type = 'click' THEN 0.75 ELSE coverage END AS DOUBLE) AS coverage,
  CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS user_key FROM p""",
)
def custom_format_parse(spark, sf_dir):
    custom = P.custom_format("clicks", r"^(clicked by) user=(\d+) in=(\S+)$", ("message", "user_key", "shard"), use_message=True)
    parsed = P.parse_multi_format(mixed_lines(spark, sf_dir), custom=(custom,))
    return parsed.select(
        "log_id", "parser_used", "coverage", F.try_element_at("metadata_kv", F.lit("user_key")).alias("user_key")
    )


@query(
    "probe_pattern",
    _MIXED
    + """ SELECT log_id, regexp_matches(value, 'user=(\\d+)(?: in=(\\S+))?') AS matches,
  CASE WHEN regexp_matches(value, 'user=(\\d+)') THEN regexp_extract(value, 'user=(\\d+)', 1) END AS user_key,
  CASE WHEN regexp_matches(value, 'user=(\\d+)') THEN 2 END AS groups_count FROM p""",
)
def probe_pattern(spark, sf_dir):
    probed = P.probe_pattern(mixed_lines(spark, sf_dir), r"user=(\d+)(?: in=(\S+))?", ("user_key", "shard"))
    return probed.select("log_id", "matches", F.col("groups")["user_key"].alias("user_key"), "groups_count")
