"""The tables as log data, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timberflow.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

INPUT_PARTITIONS = "spark.timberflow.inputPartitions"


def query(name: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)`` and, if given, its SQL twin."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over as many partitions as ``spark.timberflow.inputPartitions``
    says, before costly per-row work; as the scan splits it where that is unset.
    To be set where a table is a few unsplittable files, as in the bench."""
    parts = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def micros(column: str | Column = "ts") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def event_logs(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    """``events`` as log rows: user picks the service, type the level.
    ``costly`` says that much work per row follows."""
    level = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "purchase", "WARN")
        .when(F.col("event_type") == "view", "DEBUG")
        .otherwise("INFO")
    )
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    events = table(spark, sf_dir, "events")
    return (spread(events) if costly else events).select(
        F.col("event_id").alias("log_id"),
        "ts",
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service_id"),
        level.alias("level"),
        F.concat("event_type", F.lit(" value="), cents, F.lit(" "), "props").alias("message"),
        "user_id",
        "event_type",
        "value",
        "props",
    )


EVENT_LOGS = """
logs AS (
  SELECT event_id AS log_id, ts, 'svc-' || CAST(user_id % 8 AS VARCHAR) AS service_id,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'
                         WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
         event_type || ' value=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ' ' || props AS message,
         user_id, event_type, value, props
  FROM events)"""


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as log rows: the source is the service."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("log_id"), F.col("source").alias("service_id"), F.col("text").alias("message"), "lang"
    )
