"""Ordered per-key processing on event time.

Rows wait in state until the watermark passes them and are then handled in
(time, tie) order, so the result does not depend on how the input was cut into
files or batches. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from timberflow.functions.levels import ERROR_LEVELS
from timberflow.operators.alerts import DEDUP_SECONDS
from timberflow.operators.anomalies import HISTORY, THRESHOLD, WINDOW_SECONDS

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store; its changelog goes to the
    query's checkpoint, so state survives a lost executor."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _Ordered(StatefulProcessor):
    """Holds rows back until the watermark has passed them."""

    payload = "micros bigint, tie bigint, level string, message string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.payload)
        self.open_state(handle)

    def open_state(self, handle) -> None:
        raise NotImplementedError

    def handle_row(self, key, row):
        """Update the state with one row; a result tuple or None."""
        raise NotImplementedError

    def finish(self) -> None:
        """Write changed state back."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            values = frame[["micros", "tie", "level", "message"]].itertuples(index=False, name=None)
            self.waiting.appendList([(int(m), int(t), level, message) for m, t, level, message in values])
            newest = int(frame["micros"].max())
            latest = newest if latest is None else max(latest, newest)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda row: row[:2]) if self.waiting.exists() else []
        due = [row for row in rows if row[0] <= passed]
        later = [row for row in rows if row[0] > passed]
        if not due:
            self.expire(passed)
            return iter(())
        self.start()
        results = [out for out in (self.handle_row(key, row) for row in due) if out is not None]
        self.finish()
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if not results:
            return iter(())
        return iter([pd.DataFrame(results, columns=self.columns)])

    def start(self) -> None:
        """Read the state a run of rows needs."""

    def expire(self, passed: int) -> None:
        """Drop state that no row later than ``passed`` can need."""

    def close(self) -> None:
        pass


class TrailingScores(_Ordered):
    """Trailing error count and z-score of each error event of a service."""

    columns = ["service_id", "log_id", "micros", "level", "message", "error_count", "z_score"]

    def __init__(self, window_seconds: int, history: int, threshold: float | None) -> None:
        self.window = window_seconds * 1_000_000
        self.history = history
        self.threshold = threshold

    def open_state(self, handle) -> None:
        self.recent = handle.getListState("recent", "micros bigint")
        self.counts = handle.getListState("counts", "n bigint")

    def start(self) -> None:
        self.times = [row[0] for row in self.recent.get()] if self.recent.exists() else []
        self.past = [row[0] for row in self.counts.get()] if self.counts.exists() else []

    def handle_row(self, key, row):
        import statistics

        micros, tie, level, message = row
        self.times = [t for t in self.times if t > micros - self.window]
        self.times.append(micros)
        self.past = [*self.past, len(self.times)][-self.history :]
        spread = statistics.stdev(self.past) if len(self.past) > 1 else 0.0
        score = (len(self.times) - statistics.fmean(self.past)) / spread if spread else 0.0
        if self.threshold is not None and score < self.threshold:
            return None
        return (key[0], tie, micros, level, message, len(self.times), score)

    def finish(self) -> None:
        self.recent.put([(t,) for t in self.times])
        self.counts.put([(n,) for n in self.past])


class FiredAlerts(_Ordered):
    """The alerts of a key that fire: one, then none for a while. A key's state
    leaves once the watermark is two windows past its last alert."""

    columns = ["deduplication_key", "log_id", "micros"]

    def __init__(self, window_seconds: int) -> None:
        self.window = window_seconds * 1_000_000

    def open_state(self, handle) -> None:
        self.last = handle.getValueState("last", "micros bigint")

    def handle_row(self, key, row):
        micros, tie = row[0], row[1]
        previous = self.last.get() if self.last.exists() else None
        if previous is not None and micros - previous[0] < self.window:
            return None
        self.last.update((micros,))
        return (key[0], tie, micros)

    def finish(self) -> None:
        if self.last.exists():
            self.handle.registerTimer((self.last.get()[0] + 2 * self.window) // 1000 + 1)

    def expire(self, passed: int) -> None:
        if self.last.exists() and passed >= self.last.get()[0] + 2 * self.window:
            self.last.clear()


def _prepared(stream: DataFrame, ts: str, tie: str, delay: str) -> DataFrame:
    return (
        stream.withColumn("__event_time", F.col(ts).cast("timestamp"))
        .withWatermark("__event_time", delay)
        .withColumn("micros", F.unix_micros("__event_time"))
        .withColumn("tie", F.col(tie).cast("bigint"))
    )


def stream_anomalies(
    logs: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    history: int = HISTORY,
    threshold: float | None = THRESHOLD,
    delay: str = "10 minutes",
    ts: str = "ts",
    tie: str = "log_id",
) -> DataFrame:
    """Streaming form of ``error_rate_anomalies``. One service is one key: its
    rows stream through one task, in state bounded by the window, the history
    and the watermark delay."""
    use_rocksdb(logs.sparkSession)
    errors = _prepared(logs.filter(F.col("level").isin(*ERROR_LEVELS)), ts, tie, delay)
    return (
        errors.groupBy("service_id")
        .transformWithStateInPandas(
            TrailingScores(window_seconds, history, threshold),
            "service_id string, log_id bigint, micros bigint, level string, message string, error_count bigint, z_score double",
            "append",
            "EventTime",
        )
        .withColumn("ts", F.timestamp_micros("micros"))
        .withColumn("anomaly_score", F.round("z_score", 2))
        .withColumn("severity", F.lit("critical"))
        .drop("micros")
    )


def stream_fired_alerts(
    matches: DataFrame,
    window_seconds: int = DEDUP_SECONDS,
    delay: str = "10 minutes",
    ts: str = "ts",
    tie: str = "log_id",
) -> DataFrame:
    """Streaming form of ``deduplicate_alerts``: key, log id and time of the
    alerts that fire."""
    use_rocksdb(matches.sparkSession)
    rows = _prepared(matches, ts, tie, delay)
    for name in ("level", "message"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return (
        rows.groupBy("deduplication_key")
        .transformWithStateInPandas(
            FiredAlerts(window_seconds), "deduplication_key string, log_id bigint, micros bigint", "append", "EventTime"
        )
        .withColumn("ts", F.timestamp_micros("micros"))
        .drop("micros")
    )


def stream_volumes(logs: DataFrame, bucket: str = "5 minutes", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Logs per service and closed tumbling bucket."""
    return (
        logs.withColumn("__event_time", F.col(ts).cast("timestamp"))
        .withWatermark("__event_time", delay)
        .groupBy("service_id", F.window("__event_time", bucket).alias("w"))
        .agg(F.count("*").alias("log_count"))
        .select("service_id", F.col("w.start").alias("bucket_start"), "log_count")
    )
