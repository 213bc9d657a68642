"""Queue payloads (``{"parsed": …, "metadata": …}``) and their dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timberflow.functions.masks import semantic_text, variant_text
from timberflow.functions.services import indexed_service_name
from timberflow.functions.text import is_blank, non_empty
from timberflow.functions.timestamps import event_time
from timberflow.operators.pinning import pin
from timberflow.schema import stable_id


def queue_payload(logs: DataFrame) -> DataFrame:
    """Canonical rows as queue messages: ``key`` (the log id) and ``value``."""
    parsed = F.struct(
        "timestamp", "level", "service_id", "service", "host", "message", "source",
        F.col("metadata_kv").alias("metadata"), "parser_type", "raw",
    )
    return logs.select(
        F.col("log_id").alias("key"),
        F.to_json(F.struct(parsed.alias("parsed"), F.col("metadata_kv").alias("metadata"))).alias("value"),
    )


def classify_payloads(df: DataFrame) -> DataFrame:
    """Adds ``outcome``: ``malformed_payloads`` for blank text, JSON that is no
    object, or no ``parsed`` object; ``failed_logs`` for broken JSON; else
    ``processed_logs``."""
    body = F.try_parse_json("value")
    kind = F.schema_of_variant(F.col("__body"))
    parsed_kind = F.schema_of_variant(F.try_variant_get("__body", "$.parsed", "variant"))
    return (
        pin(df, {"__body": body})
        .withColumn(
            "outcome",
            F.when(is_blank(F.col("value")), "malformed_payloads")
            .when(F.col("__body").isNull(), "failed_logs")
            .when(~kind.startswith("OBJECT"), "malformed_payloads")
            .when(F.coalesce(parsed_kind.startswith("OBJECT"), F.lit(False)), "processed_logs")
            .otherwise("malformed_payloads"),
        )
        .drop("__body")
    )


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("outcome").agg(F.count("*").alias("payloads"))


def dead_letters(classified: DataFrame) -> DataFrame:
    return classified.filter("outcome <> 'processed_logs'")


def payload_logs(classified: DataFrame, key: str = "key") -> DataFrame:
    """Good payloads as rows to index: level, message, service and the text to
    embed. A missing message is the parsed part itself, as JSON."""
    good = pin(classified.filter("outcome = 'processed_logs'"), {"__body": F.try_parse_json("value")})
    parsed = F.try_variant_get("__body", "$.parsed", "variant")
    flat = lambda path: F.coalesce(
        F.from_json(F.to_json(F.try_variant_get("__body", path, "variant")), "map<string,string>"),
        F.create_map().cast("map<string,string>"),
    )
    staged = pin(good, {"metadata_kv": F.map_concat(flat("$.metadata"), flat("$.parsed.metadata"))})
    rows = pin(
        staged,
        {
            "level": F.coalesce(
                variant_text(parsed, "$.level"), non_empty(F.try_element_at("metadata_kv", F.lit("level"))), F.lit("UNKNOWN")
            ),
            "parser_type": F.coalesce(variant_text(parsed, "$.parser_type"), F.lit("unknown")),
            "timestamp": F.coalesce(
                variant_text(parsed, "$.timestamp"), F.try_element_at("metadata_kv", F.lit("timestamp"))
            ),
            "message": F.coalesce(
                variant_text(parsed, "$.message"),
                variant_text(parsed, "$.msg"),
                variant_text(parsed, "$.content"),
                F.to_json(parsed),
            ),
            "service_id": indexed_service_name(F.try_variant_get(parsed, "$.service", "string"), F.col("metadata_kv")),
        },
    )
    return rows.select(
        F.coalesce(F.col(key).cast("string"), stable_id(F.col("value"))).alias("log_id"),
        "timestamp",
        event_time(F.col("timestamp")).alias("ts"),
        "level",
        "message",
        "service_id",
        "parser_type",
        "metadata_kv",
        semantic_text(
            F.col("message"), F.col("level"), F.col("service_id"), F.to_json("metadata_kv")
        ).alias("semantic_text"),
    )
