"""Operational metrics over latency reports
(``operation, latency_ms, batch_size, success``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timberflow.operators.sequences import ranked_values

# Thresholds with their advice.
ADVICE = (
    ("average_latency_ms", ">", 1000, "Average latency exceeds 1 second. Consider increasing batch size."),
    ("p99_latency_ms", ">", 5000, "P99 latency is high. Consider adding more parallel workers."),
    ("embedding_cache_hit_rate", "<", 0.5, "Embedding cache hit rate is low. Consider increasing cache size."),
    ("logs_processed_per_second", "<", 100, "Throughput is low. Enable parallel processing and increase batch size."),
)
ALL_WELL = "Performance is optimal. Continue monitoring."


def newest_reports(reports: DataFrame, ts: str = "ts", tie: str = "event_id", keep: int | None = None) -> DataFrame:
    """The newest ``keep`` reports by arrival (each task keeps that many), or
    all."""
    if keep is None:
        return reports
    return reports.orderBy(F.desc(ts), F.desc(tie)).limit(keep)


def latency_metrics(
    reports: DataFrame, by: str | None = "operation", cache_hit_rate: Column | float = 0.0
) -> DataFrame:
    """Per operation (or in all, with ``by=None``): mean, exact p95 and p99 as
    ``sorted[int(n * p)]``, throughput, mean batch size cut to an integer and
    successes."""
    key = by or "__all"
    rows = reports if by else reports.withColumn(key, F.lit(1))
    sums = rows.groupBy(key).agg(
        F.avg("latency_ms").alias("average_latency_ms"),
        F.coalesce(
            F.try_divide(F.count_if("success"), F.sum("latency_ms") / 1000), F.lit(0.0)
        ).alias("logs_processed_per_second"),
        F.avg(F.coalesce("batch_size", F.lit(0))).cast("int").alias("batch_size"),
        F.count_if("success").alias("total_processed"),
        F.count("*").alias("reports"),
    )
    ranks = ranked_values(rows, key, "latency_ms", {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99})
    rate = cache_hit_rate if isinstance(cache_hit_rate, Column) else F.lit(float(cache_hit_rate))
    out = sums.join(ranks, key).withColumn("embedding_cache_hit_rate", rate)
    return out if by else out.drop(key)


def recommendations(metrics: DataFrame) -> DataFrame:
    """Adds ``recommendations``: the advice of every threshold crossed."""
    advice = []
    for name, sign, bound, text in ADVICE:
        crossed = F.col(name) > bound if sign == ">" else F.col(name) < bound
        advice.append(F.when(crossed, F.lit(text)))
    crossed = F.array_compact(F.array(*advice))
    return metrics.withColumn(
        "recommendations", F.when(F.size(crossed) > 0, crossed).otherwise(F.array(F.lit(ALL_WELL)))
    )


def health(metrics: DataFrame) -> DataFrame:
    healthy = (F.col("average_latency_ms") < 1000) & (F.col("embedding_cache_hit_rate") > 0.3)
    return metrics.withColumn("status", F.when(healthy, "healthy").otherwise("degraded"))
