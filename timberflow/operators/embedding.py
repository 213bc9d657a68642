"""Text to vector, once per distinct text."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from timberflow.functions.text import non_empty
from timberflow.functions.vectors import unit_vector
from timberflow.operators.pinning import pin

Embedder = Callable[[DataFrame, str, str], DataFrame]


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """A deterministic embedder from Spark ML parts: tokens, hashed counts,
    length 1. A stand-in for a model where none is at hand."""

    def embed(df: DataFrame, text: str, vector: str) -> DataFrame:
        from pyspark.ml.feature import HashingTF, Tokenizer
        from pyspark.ml.functions import vector_to_array

        tokens = Tokenizer(inputCol=text, outputCol="__tokens").transform(df)
        hashed = HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=dimensions).transform(tokens)
        return pin(hashed, {vector: unit_vector(vector_to_array("__tf")).cast("array<float>")}).drop(
            "__tokens", "__tf"
        )

    return embed


def udf_embedder(model: Callable[[Column], Column]) -> Embedder:
    """Wrap a user's pandas UDF (text to ``array<float>``); its Arrow batches
    are the model's batches, and a failed task is its retry."""

    def embed(df: DataFrame, text: str, vector: str) -> DataFrame:
        return df.withColumn(vector, model(F.col(text)))

    return embed


def embed_texts(
    df: DataFrame, text: str, embedder: Embedder, vector: str = "vector", partitions: int | None = None
) -> DataFrame:
    """Embed each distinct text once and join the vectors back.

    ``partitions`` spreads the distinct texts over that many workers. Copies of
    one text share a join key; adaptive skew handling splits such a key.
    """
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    distinct = df.select(key.alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).dropDuplicates(["__key"])
    if partitions:
        distinct = distinct.repartition(partitions, "__key")
    vectors = embedder(distinct, "__text", vector).select("__key", vector)
    return df.withColumn("__key", key).join(vectors, "__key").drop("__key")


def cache_hit_rate(df: DataFrame, text: str) -> DataFrame:
    """One row: share of texts a cache of all earlier texts would serve."""
    per_text = df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("key")).agg(F.count("*").alias("n"))
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requests"),
        F.count("*").alias("misses"),
        F.coalesce(1 - F.try_divide(F.count("*"), F.sum("n")), F.lit(0.0)).alias("hit_rate"),
    )


def processed_rows(df: DataFrame, default_time: Column) -> DataFrame:
    """Shape queue rows (``parsed`` struct with timestamp, level and message;
    ``message``; ``metadata`` map; ``parser_type``) for indexing, with
    defaults for what is missing."""
    return df.select(
        F.coalesce("parsed.timestamp", default_time).alias("timestamp"),
        F.coalesce("parsed.level", F.lit("INFO")).alias("level"),
        F.coalesce("parsed.message", "message", F.lit("")).alias("message"),
        F.coalesce(non_empty(F.col("parsed.message")), "message", F.lit("")).alias("embedding_text"),
        F.coalesce(F.try_element_at("metadata", F.lit("service")), F.lit("unknown")).alias("service_id"),
        "metadata",
        "parser_type",
    )


def partition_statistics(df: DataFrame) -> DataFrame:
    """Rows per Spark partition: how evenly the work is spread."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
