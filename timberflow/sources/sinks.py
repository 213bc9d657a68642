"""Table writers: indexed logs, clusters, incidents, archive and retention.

Tables are plain Parquet folders. Cluster state is a versioned snapshot and a
delta per batch after it, so a batch writes what it touched and a failed batch
never damages the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RETENTION_HOURS = 168

# Folders by hash of the cluster id in every snapshot and delta.
CLUSTER_BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table at ``path``, or None before its first write."""
    if not _exists(spark, path):
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_new_logs(logs: DataFrame, path: str, partition: str = "service_id", salt_files: int = 1) -> None:
    """Append the logs whose id the table does not hold yet.

    Rows go to one folder per service. ``salt_files`` tasks share each service,
    so raise it when one service dominates; 0 leaves the rows where they are.
    """
    spark = logs.sparkSession
    fresh = logs.dropDuplicates(["log_id"])
    stored = read_table(spark, path)
    if stored is not None:
        fresh = fresh.join(stored.select("log_id"), "log_id", "left_anti")
    if salt_files:
        salt = F.pmod(F.xxhash64("log_id"), F.lit(salt_files))
        fresh = fresh.repartition(F.col(partition), salt)
    fresh.write.mode("append").partitionBy(partition).parquet(path)


def snapshot_path(path: str, version: int) -> str:
    return f"{path}/version={version:020d}"


def delta_path(path: str, version: int) -> str:
    return f"{path}/delta={version:020d}"


def _versions(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Versions of the ``kind=...`` folders at ``path`` that were written whole
    (their ``_SUCCESS`` marker is there), ascending."""
    if not _exists(spark, path):
        return []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    names = [status.getPath().getName() for status in folder.getFileSystem(conf).listStatus(folder)]
    found = sorted(int(name.split("=")[1]) for name in names if name.startswith(f"{kind}="))
    return [version for version in found if _exists(spark, f"{path}/{kind}={version:020d}/_SUCCESS")]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("cluster_id"), F.lit(CLUSTER_BUCKETS)).cast("int")


def _within(df: DataFrame, buckets: list[int] | None) -> DataFrame:
    """``df`` without its bucket, limited to ``buckets``; folders of other
    buckets are not read."""
    if buckets is not None:
        df = df.filter((F.col("bucket") if "bucket" in df.columns else _bucket()).isin(buckets))
    return df.drop("bucket")


def latest_snapshot(
    spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None
) -> DataFrame | None:
    """Stored rows as of the newest version (older than ``before``): the newest
    snapshot, replaced row by row by the deltas after it. None where nothing is
    stored yet."""
    return _state(spark, path, before, before, buckets)


def _state(
    spark: SparkSession, path: str, before: int | None, base_before: int | None, buckets: list[int] | None
) -> DataFrame | None:
    bases = [v for v in _versions(spark, path, "version") if base_before is None or v < base_before]
    newest = bases[-1] if bases else -1
    deltas = [v for v in _versions(spark, path, "delta") if v > newest and (before is None or v < before)]
    base = _within(spark.read.parquet(snapshot_path(path, newest)), buckets) if bases else None
    if not deltas:
        return base
    changes = _within(
        spark.read.option("basePath", path).parquet(*[delta_path(path, v) for v in deltas]), buckets
    )
    rows = F.struct(*[name for name in changes.columns if name != "delta"])
    last = changes.groupBy("cluster_id").agg(F.max_by(rows, "delta").alias("row")).select("row.*")
    live = last.filter(~F.col("removed")).drop("removed")
    if base is None:
        return live
    return base.join(last.select("cluster_id"), "cluster_id", "left_anti").unionByName(live)


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("overwrite").parquet(snapshot_path(path, version))


def _write_buckets(rows: DataFrame, folder: str) -> None:
    rows.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
        folder
    )


def upsert_clusters(batch: DataFrame, path: str, version: int) -> None:
    """Merge the cluster rows of a batch into the stored ones (see
    :func:`merged_clusters`) and write only the rows it touched, as the delta of
    ``version``. Only buckets that the batch touches are read. Repeating a
    version starts from the state before it and writes the same rows again. An empty batch writes nothing.
    """
    spark = batch.sparkSession
    # At most CLUSTER_BUCKETS numbers.
    buckets = [row.bucket for row in batch.select(_bucket().alias("bucket")).distinct().collect()]
    if not buckets:
        return
    current = latest_snapshot(spark, path, version, buckets)
    if current is not None:
        current = current.join(batch.select("cluster_id"), "cluster_id", "left_semi")
    rows = merged_clusters(current, batch).withColumn("removed", F.lit(False))
    _write_buckets(rows, delta_path(path, version))


def remove_clusters(ids: DataFrame, path: str, version: int) -> None:
    """Take the clusters of ``ids`` (``cluster_id``) out as of ``version``, by
    rows that mark them as removed. Unknown ids are ignored; a later batch may
    bring a removed id back as a new cluster."""
    current = latest_snapshot(ids.sparkSession, path, version)
    if current is None:
        return
    gone = current.join(ids.select("cluster_id"), "cluster_id", "left_semi")
    if gone.isEmpty():
        return
    empty = {f.name: F.lit(None).cast(f.dataType) for f in current.schema if f.name != "cluster_id"}
    _write_buckets(gone.withColumns(empty | {"removed": F.lit(True)}), delta_path(path, version))


def compact_clusters(spark: SparkSession, path: str, version: int) -> None:
    """Fold all deltas up to ``version`` into a snapshot of that version. It
    never reads what it writes, so it can be repeated."""
    state = _state(spark, path, version + 1, version, None)
    if state is None:
        return
    if state.isEmpty():
        write_snapshot(state, path, version)  # no folders, but the schema
    else:
        _write_buckets(state, snapshot_path(path, version))


def superseded(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Folders that no reader of the newest ``keep`` snapshots needs: older
    snapshots, and the deltas that the oldest kept one includes."""
    bases = _versions(spark, path, "version")
    if len(bases) < keep:
        return []
    oldest = bases[-keep]
    return [snapshot_path(path, v) for v in bases if v < oldest] + [
        delta_path(path, v) for v in _versions(spark, path, "delta") if v <= oldest
    ]


def merged_clusters(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Merge cluster rows of a batch into the stored ones: counts add up, times
    widen, the newest samples lead, and the vector becomes the latest
    member's. ``batch`` has one row per cluster."""
    if current is None:
        return batch
    old, new = current.alias("old"), batch.alias("new")
    count_old = F.coalesce(F.col("old.occurrence_count"), F.lit(0))
    count_new = F.coalesce(F.col("new.occurrence_count"), F.lit(0))
    fresh_samples = F.coalesce(F.col("new.sample_logs"), F.array().cast("array<string>"))
    kept_samples = F.coalesce(F.col("old.sample_logs"), F.array().cast("array<string>"))
    samples = F.slice(F.concat(F.array_except(fresh_samples, kept_samples), kept_samples), 1, 5)
    average = F.when(count_old == 0, F.col("new.similarity_score_average")).when(
        count_new == 0, F.col("old.similarity_score_average")
    ).otherwise(
        # The stored 0 of a single log is read back as "none yet".
        F.when(F.col("old.similarity_score_average") == 0, F.col("new.score_first") + F.col("new.score_sum"))
        .otherwise(F.col("old.similarity_score_average") * count_old + F.col("new.score_sum"))
        / (count_old + count_new)
    )
    return old.join(new, "cluster_id", "full_outer").select(
        "cluster_id",
        F.coalesce("old.representative_log", "new.representative_log").alias("representative_log"),
        (count_old + count_new).alias("occurrence_count"),
        F.least("old.first_seen", "new.first_seen").alias("first_seen"),
        F.greatest("old.last_seen", "new.last_seen").alias("last_seen"),
        samples.alias("sample_logs"),
        average.alias("similarity_score_average"),
        F.coalesce("old.service_name", "new.service_name").alias("service_name"),
        F.lit(0.0).alias("score_first"),
        F.lit(0.0).alias("score_sum"),
        F.coalesce("new.vector", "old.vector").alias("vector"),
    )


def write_incidents(incidents: DataFrame, path: str) -> None:
    """Append incidents with an explanation that are not stored yet."""
    fresh = incidents.filter(F.length(F.trim("explanation")) > 0).dropDuplicates(["incident_id"])
    stored = read_table(incidents.sparkSession, path)
    if stored is not None:
        fresh = fresh.join(stored.select("incident_id"), "incident_id", "left_anti")
    fresh.write.mode("append").parquet(path)


def write_archive(logs: DataFrame, path: str, ts: str = "ts", batch: int | None = None) -> None:
    """Every log, repeats included, in a folder per day (1970-01-01 without a
    time). With a ``batch`` number the logs are that batch's folder, which a
    repeated job replaces; without one they are appended each time."""
    rows = logs.withColumn("day", F.coalesce(F.to_date(ts), F.lit("1970-01-01").cast("date")))
    mode, folder = ("append", path) if batch is None else ("overwrite", f"{path}/batch={batch:020d}")
    rows.write.mode(mode).partitionBy("day").parquet(folder)


def retained(archive: DataFrame, now: Column, hours: int = RETENTION_HOURS, ts: str = "ts") -> DataFrame:
    """Archived logs within the retention time. When the archive is stored by
    day, the day bound prunes whole folders before the exact test."""
    oldest = now - F.expr(f"interval {hours} hours")
    rows = archive.filter(F.col(ts) >= oldest)
    return rows.filter(F.col("day") >= F.to_date(oldest)) if "day" in archive.columns else rows


def expired_days(archive: DataFrame, now: Column, hours: int = RETENTION_HOURS, day: str = "day") -> DataFrame:
    """Days (and their rows) that lie wholly before the retention time: what a
    clean-up may drop, folder by folder."""
    oldest = F.to_date(now - F.expr(f"interval {hours} hours"))
    return archive.filter(F.col(day) < oldest).groupBy(day).agg(F.count("*").alias("rows"))
