"""Anomalies and alerts over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberflow.operators import alerts as A, anomalies as N
from timberflow.plans.registry import EVENT_LOGS, event_logs, micros, query


def _trailing_sql(seconds: int) -> str:
    return f"""
WITH {EVENT_LOGS},
e AS (SELECT *, epoch_us(ts) AS us FROM logs WHERE level IN ('ERROR', 'CRITICAL', 'FATAL')),
c AS (SELECT e.*, row_number() OVER (PARTITION BY service_id ORDER BY us, log_id) AS seq,
             count(*) OVER (PARTITION BY service_id ORDER BY us
                            RANGE BETWEEN UNBOUNDED PRECEDING AND {seconds * 1_000_000} PRECEDING) AS gone
      FROM e),
n AS (SELECT *, seq - gone AS error_count FROM c),
h AS (SELECT *, avg(error_count) OVER w AS mean, stddev_samp(error_count) OVER w AS spread
      FROM n WINDOW w AS (PARTITION BY service_id ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, CASE WHEN spread > 0 THEN (error_count - mean) / spread ELSE 0.0 END AS z_score FROM h)"""


_ANOMALY_COLUMNS = """
SELECT log_id, service_id, level, message, us AS ts_us, error_count, round(z_score, 6) AS z_score,
       'critical' AS severity
FROM z WHERE z_score >= 1.2"""


def _anomaly_rows(df):
    return df.select(
        "log_id",
        "service_id",
        "level",
        "message",
        micros().alias("ts_us"),
        "error_count",
        F.round("z_score", 6).alias("z_score"),
        "severity",
    )


@query("error_rate_anomalies", _trailing_sql(300) + _ANOMALY_COLUMNS)
def error_rate_anomalies(spark, sf_dir):
    return _anomaly_rows(N.error_rate_anomalies(event_logs(spark, sf_dir)))


@query("error_rate_anomalies_daily", _trailing_sql(86400) + _ANOMALY_COLUMNS)
def error_rate_anomalies_daily(spark, sf_dir):
    return _anomaly_rows(N.error_rate_anomalies(event_logs(spark, sf_dir), window_seconds=86400))


@query(
    "trailing_error_counts",
    _trailing_sql(3600) + " SELECT log_id, service_id, us AS ts_us, error_count, seq FROM z",
)
def trailing_error_counts(spark, sf_dir):
    counts = N.error_counts(event_logs(spark, sf_dir), window_seconds=3600)
    return counts.select("log_id", "service_id", micros().alias("ts_us"), "error_count", "seq")


@query(
    "scored_error_counts",
    _trailing_sql(3600) + " SELECT log_id, service_id, error_count, round(z_score, 6) AS z_score FROM z",
)
def scored_error_counts(spark, sf_dir):
    counts = N.scored_counts(N.error_counts(event_logs(spark, sf_dir), window_seconds=3600))
    return counts.select("log_id", "service_id", "error_count", F.round("z_score", 6).alias("z_score"))


@query(
    "tumbling_volume_outliers",
    f"""
WITH {EVENT_LOGS},
b AS (SELECT service_id, time_bucket(INTERVAL '1 hour', ts) AS bucket_start, count(*) AS log_count
      FROM logs GROUP BY ALL),
h AS (SELECT *, avg(log_count) OVER w AS mean, stddev_samp(log_count) OVER w AS spread
      FROM b WINDOW w AS (PARTITION BY service_id ORDER BY bucket_start ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT service_id, epoch_us(bucket_start) AS bucket_us, log_count, round((log_count - mean) / spread, 6) AS z_score
FROM h WHERE spread > 0 AND (log_count - mean) / spread >= 1.2""",
)
def tumbling_volume_outliers(spark, sf_dir):
    found = N.volume_outliers(event_logs(spark, sf_dir), "1 hour")
    return found.select(
        "service_id", micros("bucket_start").alias("bucket_us"), "log_count", F.round("z_score", 6).alias("z_score")
    )


# Rules for the queries: two by severity, one by predicate, one disabled.
RULES = [
    A.AlertRule("r-critical", "critical anomalies", severity="critical", channels=("log", "slack")),
    A.AlertRule("r-fatal", "fatal anomalies", severity="fatal", channels=("email",)),
    A.AlertRule(
        "r-burst",
        "bursts",
        condition="anomaly_score >= 2 and level = 'ERROR'",
        channels=("webhook", "pagerduty", "log"),
    ),
    A.AlertRule("r-off", "disabled", severity="critical", enabled=False),
]


def anomaly_events(spark, sf_dir):
    """Daily-window anomalies in the shape the alert operators take."""
    return N.error_rate_anomalies(event_logs(spark, sf_dir), window_seconds=86400).select(
        "log_id", "ts", "service_id", "level", "message", "anomaly_score", "severity"
    )


_EVENTS = (
    _trailing_sql(86400)
    + """,
ev AS (SELECT log_id, us, ts, service_id, level, message, round(z_score, 2) AS anomaly_score,
              'critical' AS severity FROM z WHERE z_score >= 1.2),
m AS (SELECT *, 'r-critical' AS rule_id, 'log,slack' AS channels FROM ev WHERE severity = 'critical'
      UNION ALL
      SELECT *, 'r-burst', 'webhook,pagerduty,log' FROM ev WHERE anomaly_score >= 2 AND level = 'ERROR'),
k AS (SELECT *, rule_id || ':' || service_id || ':' || level AS deduplication_key FROM m)"""
)

# Firing alerts: one recursive walk per key.
_FIRED = (
    _EVENTS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """,
f AS (SELECT deduplication_key, min(us) AS us FROM k GROUP BY 1
      UNION ALL
      SELECT f.deduplication_key,
             (SELECT min(k.us) FROM k WHERE k.deduplication_key = f.deduplication_key AND k.us >= f.us + 3600000000)
      FROM f WHERE f.us IS NOT NULL),
fired AS (SELECT k.* FROM k JOIN f ON k.deduplication_key = f.deduplication_key AND k.us = f.us
          QUALIFY row_number() OVER (PARTITION BY k.deduplication_key, k.us ORDER BY k.log_id) = 1)"""
)


def fired_alerts(spark, sf_dir):
    matched = A.match_rules(anomaly_events(spark, sf_dir), RULES)
    return A.deduplicate_alerts(matched, window_seconds=3600)


@query(
    "alert_matches",
    _EVENTS + " SELECT log_id, rule_id, channels, deduplication_key FROM k",
)
def alert_matches(spark, sf_dir):
    matched = A.match_rules(anomaly_events(spark, sf_dir), RULES)
    return matched.select(
        "log_id", "rule_id", F.array_join("channels", ",").alias("channels"), "deduplication_key"
    )


@query(
    "rule_table_matches",
    _EVENTS + " SELECT log_id, rule_id, deduplication_key FROM k WHERE rule_id = 'r-critical'",
)
def rule_table_matches(spark, sf_dir):
    rules = A.rules_frame(spark, [rule for rule in RULES if rule.condition is None])
    matched = A.match_rule_table(anomaly_events(spark, sf_dir), rules)
    return matched.select("log_id", "rule_id", "deduplication_key")


@query("alert_dedup", _FIRED + " SELECT log_id, rule_id, deduplication_key, us AS ts_us FROM fired")
def alert_dedup(spark, sf_dir):
    return fired_alerts(spark, sf_dir).select("log_id", "rule_id", "deduplication_key", micros().alias("ts_us"))


@query(
    "alert_history",
    _FIRED
    + """ SELECT log_id, rule_id, service_id, us AS ts_us FROM fired
WHERE rule_id = 'r-critical' ORDER BY us DESC, log_id DESC LIMIT 100""",
)
def alert_history(spark, sf_dir):
    history = A.alert_history(fired_alerts(spark, sf_dir), 100, rule_id="r-critical")
    return history.select("log_id", "rule_id", "service_id", micros().alias("ts_us"))


@query(
    "alert_deliveries",
    _FIRED
    + """ SELECT log_id, rule_id, channel FROM (
  SELECT log_id, rule_id, unnest(string_split(channels, ',')) AS channel FROM fired) WHERE channel <> 'pagerduty'""",
)
def alert_deliveries(spark, sf_dir):
    sent = A.alert_deliveries(fired_alerts(spark, sf_dir), ("log", "slack", "webhook", "email"))
    return sent.select("log_id", "rule_id", "channel")


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END"


@query(
    "alert_payloads",
    _FIRED
    + f""" SELECT log_id, rule_id,
  '{{"text":"Alert: ' || rule_id || '","attachments":[{{"color":"#ff0000","title":"' || rule_id || '","text":'
  || to_json(message) || ',"fields":[{{"title":"Severity","value":"critical","short":true}},'
  || '{{"title":"Service","value":"' || service_id || '","short":true}},'
  || '{{"title":"Anomaly Score","value":"' || anomaly_score || '","short":true}},'
  || '{{"title":"Timestamp","value":"' || {_ISO} || '","short":true}}]}}]}}' AS chat_payload,
  '{{"rule_id":"' || rule_id || '","event":{{"service_id":"' || service_id || '","level":"' || level
  || '","message":' || to_json(message) || ',"anomaly_score":' || anomaly_score || ',"severity":"critical","timestamp":"'
  || {_ISO} || '"}},"triggered_at":"' || {_ISO} || '","channels":["' || replace(channels, ',', '","')
  || '"],"deduplication_key":"' || deduplication_key || '"}}' AS webhook_payload
FROM fired""",
)
def alert_payloads(spark, sf_dir):
    return fired_alerts(spark, sf_dir).select(
        "log_id",
        "rule_id",
        A.chat_payload(F.col("ts")).alias("chat_payload"),
        A.webhook_payload(F.col("ts")).alias("webhook_payload"),
    )


@query(
    "alert_health",
    _FIRED
    + " SELECT 3::BIGINT AS rules_count, (SELECT count(*) FROM fired) AS alert_history_count, 'healthy' AS status",
)
def alert_health(spark, sf_dir):
    rules = A.register_rules(A.rules_frame(spark, RULES[:2]), A.rules_frame(spark, RULES[1:]))
    rules = A.unregister_rules(rules, "r-fatal")
    return A.alert_health(rules, fired_alerts(spark, sf_dir))


@query(
    "rule_maintenance",
    _EVENTS
    + """ SELECT rule_id, count(*) AS matches FROM (
  SELECT 'r-critical' AS rule_id FROM ev UNION ALL SELECT 'r-off' FROM ev) GROUP BY 1""",
)
def rule_maintenance(spark, sf_dir):
    """Enable one rule, disable and drop others, then match with the rest."""
    rules = A.register_rules(A.rules_frame(spark, RULES[:1]), A.rules_frame(spark, RULES))
    rules = A.set_enabled(A.unregister_rules(rules, "r-burst"), True, "r-off")
    matched = A.match_rule_table(anomaly_events(spark, sf_dir), rules)
    return matched.groupBy("rule_id").agg(F.count("*").alias("matches"))
