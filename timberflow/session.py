"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "timberflow", **extra: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow).

    On a cluster leave ``master`` unset and let ``spark-submit`` decide; the
    shuffle partition count is then AQE's starting point, to be set from the
    data volume (about 128 MB of shuffle data per partition).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    }
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else created."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # rows of several MB: a batch for a Python worker stays small
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Without one a local
    master (tests, a laptop) gets a fresh folder of its own; anywhere else that
    is an error, because executors would not see each other's files."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if target is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        target = tempfile.mkdtemp(prefix="timberflow-ckpt-")
    context.setCheckpointDir(target)
    return context.getCheckpointDir()


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: it is
    computed once, and a lost executor never forces it to be computed anew.
    ``folders`` are columns whose values get a folder each."""
    path = workspace(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor never forces
    an iterative job back to its first round."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
