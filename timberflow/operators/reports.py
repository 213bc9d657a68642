"""Log listing, dashboard and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timberflow.functions.text import non_empty

# Dashboard sizes and sentences.
DASHBOARD_ROWS = 500
RECENT_ROWS = 10
QUIET = "No anomalies detected."
BUSY = (
    "%d ERROR-level events detected across %d service(s). Review recent logs for details."
)


def with_listing_defaults(logs: DataFrame) -> DataFrame:
    return logs.withColumns(
        {
            "level": F.coalesce("level", F.lit("INFO")),
            "message": F.coalesce("message", F.lit("")),
        }
    )


def filter_logs(
    logs: DataFrame, level: str | None = None, start: str | None = None, end: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Level equality and an inclusive time range, on typed columns so both
    reach the Parquet scan."""
    kind = logs.schema[ts].dataType
    if level:
        logs = logs.filter(F.col("level") == level.upper())
    if start:
        logs = logs.filter(F.col(ts) >= F.lit(start).cast(kind))
    if end:
        logs = logs.filter(F.col(ts) <= F.lit(end).cast(kind))
    return logs


def log_page(
    logs: DataFrame,
    page: int = 1,
    limit: int = 10,
    level: str | None = None,
    start: str | None = None,
    end: str | None = None,
    ts: str = "ts",
    tie: str = "log_id",
) -> DataFrame:
    """One page, newest first, rows without time last. Each task keeps only
    ``page * limit`` rows; nothing else is sorted."""
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("page starts at 1 and limit is between 1 and 100")
    wanted = filter_logs(logs, level, start, end, ts)
    ordered = with_listing_defaults(wanted).orderBy(F.desc_nulls_last(ts), tie)
    return ordered.offset((page - 1) * limit).limit(limit)


def page_totals(
    logs: DataFrame,
    limit: int = 10,
    level: str | None = None,
    start: str | None = None,
    end: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """One row: ``total`` and ``pages`` of a listing."""
    total = filter_logs(logs, level, start, end, ts).agg(F.count("*").alias("total"))
    return total.withColumn("pages", F.ceil(F.col("total") / limit))


def newest(logs: DataFrame, count: int = DASHBOARD_ROWS, ts: str = "ts", tie: str = "log_id") -> DataFrame:
    return logs.orderBy(F.desc_nulls_last(ts), tie).limit(count)


def display_service(service: Column, metadata: Column | None = None) -> Column:
    options = [non_empty(service)]
    if metadata is not None:
        options += [non_empty(F.try_element_at(metadata, F.lit(key))) for key in ("service", "service_id")]
    return F.coalesce(*options, F.lit("unknown"))


def dashboard_summary(
    logs: DataFrame, rows: int | None = None, ts: str = "ts", tie: str = "log_id", metadata: str | None = None
) -> DataFrame:
    """One row: total logs, ERROR logs and services among all of them (or the
    newest ``rows``), and a sentence about them."""
    window = logs if rows is None else newest(logs, rows, ts, tie)
    service = display_service(F.col("service_id"), F.col(metadata) if metadata else None)
    counted = window.agg(
        F.count_if(F.col("level") == "ERROR").alias("anomalies"),
        F.count_distinct(service).alias("active_services"),
    )
    return (
        counted.withColumn("logs_processed", logs.agg(F.count("*")).scalar())
        .withColumn("ai_insights", F.col("anomalies"))
        .withColumn(
            "ai_summary",
            F.when(F.col("anomalies") == 0, QUIET).otherwise(
                F.format_string(BUSY, "anomalies", "active_services")
            ),
        )
    )


def recent_logs(
    logs: DataFrame, rows: int = RECENT_ROWS, ts: str = "ts", tie: str = "log_id", metadata: str | None = None
) -> DataFrame:
    service = display_service(F.col("service_id"), F.col(metadata) if metadata else None)
    return with_listing_defaults(newest(logs, rows, ts, tie)).withColumn("service", service)


def service_level_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("service_id", "level").agg(F.count("*").alias("logs"))


def service_level_rollup(logs: DataFrame) -> DataFrame:
    """Counts per (service, level), per service, and in all (nulls mark the
    level of the total)."""
    return logs.rollup("service_id", "level").agg(F.count("*").alias("logs"))
