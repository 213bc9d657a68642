"""Error-rate anomaly detection in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timberflow.functions.levels import ERROR_LEVELS
from timberflow.operators.sequences import moving_frame, trailing_counts

# Window, history length and threshold of the detector.
WINDOW_SECONDS = 300
HISTORY = 50
THRESHOLD = 1.2


def error_events(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("level").isin(*ERROR_LEVELS))


def error_counts(
    logs: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    service: str = "service_id",
    ts: str = "ts",
    tie: str = "log_id",
) -> DataFrame:
    """Each error event with ``error_count``, the errors of its service in the
    trailing window that ends with it, and ``seq``, its position."""
    errors = error_events(logs).withColumn("__micros", F.unix_micros(F.col(ts).cast("timestamp")))
    return (
        trailing_counts(errors, service, "__micros", tie, window_seconds)
        .withColumnRenamed("trailing", "error_count")
        .drop("__micros")
    )


def scored_counts(counts: DataFrame, history: int = HISTORY, service: str = "service_id") -> DataFrame:
    """Adds ``z_score`` of each count against the last ``history`` counts of
    its service (itself included); 0 with fewer than two counts or no spread."""
    framed = moving_frame(
        counts,
        service,
        "seq",
        history,
        {"__mean": F.avg("error_count"), "__spread": F.stddev_samp("error_count")},
    )
    return framed.withColumn(
        "z_score",
        F.when(F.col("__spread") > 0, (F.col("error_count") - F.col("__mean")) / F.col("__spread")).otherwise(0.0),
    ).drop("__mean", "__spread")


def error_rate_anomalies(
    logs: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    history: int = HISTORY,
    threshold: float = THRESHOLD,
    service: str = "service_id",
    ts: str = "ts",
    tie: str = "log_id",
) -> DataFrame:
    """Anomaly events: error events whose z-score reaches the threshold.

    Event time stands in for the wall clock, so a replay gives the same rows.
    ``z_score`` is the raw score, ``anomaly_score`` the one for display.
    """
    scored = scored_counts(error_counts(logs, window_seconds, service, ts, tie), history, service)
    return (
        scored.filter(F.col("z_score") >= threshold)
        .withColumn("anomaly_score", F.round("z_score", 2))
        .withColumn("severity", F.lit("critical"))
    )


def volume_outliers(
    logs: DataFrame,
    bucket: str = "5 minutes",
    history: int = HISTORY,
    threshold: float = THRESHOLD,
    service: str = "service_id",
    ts: str = "ts",
) -> DataFrame:
    """Tumbling buckets of all logs per service, scored like the error counts.

    Counting combines before the shuffle, so a hot service costs no more than
    one row per bucket; buckets without logs are not counted.
    """
    buckets = (
        logs.groupBy(service, F.window(ts, bucket).alias("__window"))
        .agg(F.count("*").alias("error_count"))
        .withColumn("bucket_start", F.col("__window.start"))
        .drop("__window")
    )
    from pyspark.sql import Window as W

    # One row per bucket is left here: the ordering below is over time, not logs.
    numbered = buckets.withColumn("seq", F.row_number().over(W.partitionBy(service).orderBy("bucket_start")))
    return (
        scored_counts(numbered, history, service)
        .filter(F.col("z_score") >= threshold)
        .select(service, "bucket_start", F.col("error_count").alias("log_count"), "z_score")
    )
