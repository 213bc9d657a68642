"""Listing, dashboard and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberflow.operators import metrics as ME, reports as RP
from timberflow.plans.registry import EVENT_LOGS, event_logs, micros, query, table


@query(
    "log_page",
    f"""WITH {EVENT_LOGS} SELECT log_id, level, service_id, epoch_us(ts) AS ts_us FROM logs
WHERE level = 'ERROR' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'
ORDER BY ts DESC, log_id LIMIT 25 OFFSET 50""",
)
def log_page(spark, sf_dir):
    page = RP.log_page(event_logs(spark, sf_dir), 3, 25, "error", "2024-01-05 00:00:00", "2024-01-25 00:00:00")
    return page.select("log_id", "level", "service_id", micros().alias("ts_us"))


@query(
    "page_totals",
    f"""WITH {EVENT_LOGS} SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM logs
WHERE level = 'ERROR' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'""",
)
def page_totals(spark, sf_dir):
    return RP.page_totals(event_logs(spark, sf_dir), 25, "error", "2024-01-05 00:00:00", "2024-01-25 00:00:00")


@query(
    "dashboard_summary",
    f"""WITH {EVENT_LOGS}, n AS (SELECT * FROM logs)
SELECT (SELECT count(*) FROM logs) AS logs_processed, count(*) FILTER (level = 'ERROR') AS anomalies,
  count(*) FILTER (level = 'ERROR') AS ai_insights, count(DISTINCT service_id) AS active_services,
  count(*) FILTER (level = 'ERROR') || ' ERROR-level events detected across ' || count(DISTINCT service_id)
  || ' service(s). Review recent logs for details.' AS ai_summary FROM n""",
)
def dashboard_summary(spark, sf_dir):
    return RP.dashboard_summary(event_logs(spark, sf_dir))


@query(
    "recent_logs",
    f"""WITH {EVENT_LOGS} SELECT log_id, epoch_us(ts) AS ts_us, level, message, service_id AS service
FROM logs ORDER BY ts DESC, log_id LIMIT 10""",
)
def recent_logs(spark, sf_dir):
    recent = RP.recent_logs(event_logs(spark, sf_dir))
    return recent.select("log_id", micros().alias("ts_us"), "level", "message", "service")


@query(
    "newest_raw_logs",
    f"WITH {EVENT_LOGS} SELECT log_id, epoch_us(ts) AS ts_us, message FROM logs ORDER BY ts DESC, log_id LIMIT 500",
)
def newest_raw_logs(spark, sf_dir):
    return RP.newest(event_logs(spark, sf_dir), 500).select("log_id", micros().alias("ts_us"), "message")


@query(
    "display_service",
    f"""WITH {EVENT_LOGS} SELECT log_id, CASE event_type WHEN 'error' THEN service_id WHEN 'view' THEN 'meta-' || user_id
  WHEN 'click' THEN 'id-' || user_id ELSE 'unknown' END AS service FROM logs""",
)
def display_service(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    own = F.when(kind == "error", F.col("service_id")).otherwise(F.lit(""))
    metadata = F.create_map(
        F.lit("service"), F.when(kind == "view", F.concat(F.lit("meta-"), user)).when(kind == "click", ""),
        F.lit("service_id"), F.when(kind == "click", F.concat(F.lit("id-"), user)),
    )
    return event_logs(spark, sf_dir).select("log_id", RP.display_service(own, metadata).alias("service"))


@query(
    "listing_defaults",
    f"""WITH {EVENT_LOGS} SELECT log_id, CASE WHEN level = 'DEBUG' THEN 'INFO' ELSE level END AS level,
  CASE WHEN level = 'DEBUG' THEN '' ELSE message END AS message FROM logs""",
)
def listing_defaults(spark, sf_dir):
    gaps = event_logs(spark, sf_dir).withColumns(
        {"message": F.when(F.col("level") != "DEBUG", F.col("message")), "level": F.nullif(F.col("level"), F.lit("DEBUG"))}
    )
    return RP.with_listing_defaults(gaps).select("log_id", "level", "message")


@query(
    "service_level_counts",
    f"WITH {EVENT_LOGS} SELECT service_id, level, count(*) AS logs FROM logs GROUP BY ALL",
)
def service_level_counts(spark, sf_dir):
    return RP.service_level_counts(event_logs(spark, sf_dir))


@query(
    "service_level_rollup",
    f"WITH {EVENT_LOGS} SELECT service_id, level, count(*) AS logs FROM logs GROUP BY ROLLUP (service_id, level)",
)
def service_level_rollup(spark, sf_dir):
    return RP.service_level_rollup(event_logs(spark, sf_dir))


def latency_reports(spark, sf_dir):
    """Events as latency reports: value is the latency, type the operation."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("operation"),
        F.col("value").alias("latency_ms"),
        (F.col("user_id") % 64).cast("int").alias("batch_size"),
        (F.col("user_id") % 10 != 0).alias("success"),
    )


_REPORTS = """
r AS (SELECT event_id, ts, event_type AS operation, value AS latency_ms, user_id % 64 AS batch_size, user_id % 10 <> 0 AS success FROM events)"""
_METRICS = """
  round(avg(latency_ms), 6) AS average_latency_ms,
  list_sort(list(latency_ms))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95_latency_ms,
  list_sort(list(latency_ms))[CAST(floor(count(*) * 0.99) AS INT) + 1] AS p99_latency_ms,
  round(count(*) FILTER (success) / (sum(latency_ms) / 1000), 6) AS logs_processed_per_second,
  CAST(trunc(avg(batch_size)) AS INT) AS batch_size, count(*) FILTER (success) AS total_processed, count(*) AS reports"""


def _rounded(df):
    return df.withColumns(
        {
            "average_latency_ms": F.round("average_latency_ms", 6),
            "logs_processed_per_second": F.round("logs_processed_per_second", 6),
        }
    )


@query("latency_metrics", f"WITH {_REPORTS} SELECT operation, {_METRICS} FROM r GROUP BY operation")
def latency_metrics(spark, sf_dir):
    return _rounded(ME.latency_metrics(latency_reports(spark, sf_dir))).drop("embedding_cache_hit_rate")


@query(
    "latency_overall",
    f"WITH {_REPORTS}, n AS (SELECT * FROM r) SELECT {_METRICS} FROM n",
)
def latency_overall(spark, sf_dir):
    kept = ME.newest_reports(latency_reports(spark, sf_dir))
    return _rounded(ME.latency_metrics(kept, by=None)).drop("embedding_cache_hit_rate")


@query(
    "recommendations",
    f"""WITH {_REPORTS}, m AS (SELECT operation, {_METRICS} FROM r GROUP BY operation)
SELECT operation, 'Embedding cache hit rate is low. Consider increasing cache size.' || CASE WHEN logs_processed_per_second < 100
  THEN '|Throughput is low. Enable parallel processing and increase batch size.' ELSE '' END AS recommendations FROM m""",
)
def recommendations(spark, sf_dir):
    advised = ME.recommendations(ME.latency_metrics(latency_reports(spark, sf_dir), cache_hit_rate=0.4))
    return advised.select("operation", F.array_join("recommendations", "|").alias("recommendations"))


@query(
    "metrics_health",
    f"WITH {_REPORTS} SELECT operation, CASE WHEN avg(latency_ms) < 1000 THEN 'healthy' ELSE 'degraded' END AS status FROM r GROUP BY 1",
)
def metrics_health(spark, sf_dir):
    checked = ME.health(ME.latency_metrics(latency_reports(spark, sf_dir), cache_hit_rate=0.4))
    return checked.select("operation", "status")
