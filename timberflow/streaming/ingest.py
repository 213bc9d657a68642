"""The ingest job: payload stream to archive, index and cluster tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from timberflow.functions.masks import semantic_text
from timberflow.operators.clusters import SAMPLES, THRESHOLD, assign_clusters, cluster_table, indexed_logs
from timberflow.operators.embedding import Embedder, embed_texts, hashing_embedder
from timberflow.operators.search import nearest
from timberflow.session import durable
from timberflow.sources.records import accepted, ingest_payloads, rejects
from timberflow.sources.sinks import compact_clusters, latest_snapshot, upsert_clusters, write_archive


# Batches between two snapshots of the cluster table.
COMPACT_EVERY = 32


@dataclass(frozen=True)
class Tables:
    """Folders the job writes; each batch owns its own sub-folder or version,
    and writes it whole, so a repeated batch replaces what it wrote before."""

    archive: str
    logs: str
    clusters: str
    rejects: str

    @staticmethod
    def under(root: str) -> "Tables":
        return Tables(*[f"{root}/{name}" for name in ("archive", "logs", "clusters", "rejects")])


def cluster_batch(
    batch: DataFrame, current: DataFrame | None, threshold: float = THRESHOLD
) -> DataFrame:
    """Decide a batch (with ``vector``) against the stored clusters, then its
    remaining logs among themselves."""
    if current is None:
        return assign_clusters(batch, threshold)
    # Equal vectors ask once.
    key = F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(7), F.col("vector"))))
    keyed = durable(batch.withColumn("__key", key))
    asked = keyed.groupBy(F.col("__key").alias("query_id")).agg(F.first("vector").alias("query_vector"))
    base = current.select("cluster_id", "vector")
    hits = nearest(base, asked, 1, id_col="cluster_id", min_score=threshold).select(
        F.col("query_id").alias("__key"), "cluster_id", F.col("score").alias("similarity_score")
    )
    known = (
        keyed.join(hits, "__key")
        .withColumn("is_duplicate", F.lit(True))
        .drop("__key")
    )
    fresh = assign_clusters(keyed.join(hits, "__key", "left_anti").drop("__key"), threshold)
    return known.unionByName(fresh)


def batch_clusters(decisions: DataFrame) -> DataFrame:
    """The batch's share of each cluster, with the latest member's vector and
    the score sums the running average needs."""
    arrival = F.struct("ts", "log_id")
    scores = decisions.filter("cluster_id is not null").groupBy("cluster_id").agg(
        F.max_by("vector", arrival).alias("vector"),
        F.coalesce(F.sum(F.when(F.col("is_duplicate"), F.col("similarity_score"))), F.lit(0.0)).alias("score_sum"),
        F.coalesce(
            F.min_by(F.when(F.col("is_duplicate"), F.col("similarity_score")), F.when(F.col("is_duplicate"), arrival)),
            F.lit(0.0),
        ).alias("score_first"),
    )
    table = cluster_table(decisions, samples=SAMPLES)
    return table.join(scores, "cluster_id").select(
        "cluster_id",
        "representative_log",
        "occurrence_count",
        "first_seen",
        "last_seen",
        "sample_logs",
        "similarity_score_average",
        "service_name",
        "score_first",
        "score_sum",
        "vector",
    )


def ingest_batch(
    batch: DataFrame, batch_id: int, tables: Tables, embedder: Embedder | None = None, threshold: float = THRESHOLD
) -> None:
    """One micro-batch (``record_id``, ``value``), for ``foreachBatch``.

    Every accepted log goes to the archive; only logs that start a cluster go
    to the index. Rejected rows are kept with their reason.
    """
    spark = batch.sparkSession
    rows = durable(ingest_payloads(batch))
    folder = f"batch={batch_id:020d}"
    rejects(rows).write.mode("overwrite").parquet(f"{tables.rejects}/{folder}")
    logs = accepted(rows)
    write_archive(logs, tables.archive, batch=batch_id)

    metadata = F.to_json("metadata_kv")
    text = semantic_text(F.col("message"), F.col("level"), F.col("service_id"), metadata)
    embedded = embed_texts(logs.withColumn("semantic_text", text), "semantic_text", embedder or hashing_embedder())
    decisions = durable(cluster_batch(embedded, latest_snapshot(spark, tables.clusters, before=batch_id), threshold))
    upsert_clusters(durable(batch_clusters(decisions)), tables.clusters, batch_id)
    if (batch_id + 1) % COMPACT_EVERY == 0:
        compact_clusters(spark, tables.clusters, batch_id)
    indexed_logs(decisions).drop("is_duplicate", "similarity_score").write.mode("overwrite").partitionBy(
        "service_id"
    ).parquet(f"{tables.logs}/{folder}")


def start_ingest(
    payloads: DataFrame,
    tables: Tables,
    checkpoint: str,
    embedder: Embedder | None = None,
    threshold: float = THRESHOLD,
    once: bool = False,
):
    """Start the job on a payload stream (files, or Kafka with its key and
    value named ``record_id`` and ``value``)."""
    writer = payloads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: ingest_batch(batch, batch_id, tables, embedder, threshold)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
