"""Root-cause context as a batch job: reuse, retrieve, assemble, complete."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from timberflow.functions.text import filled, strip
from timberflow.operators.search import nearest

# Reuse threshold, context sizes and prompt wording.
REUSE_THRESHOLD = 0.95
DEFAULT_CONTEXT = 5
MAX_CONTEXT = 20
SEARCH_PROMPT = (
    "You are an expert system reliability assistant for %s.\n"
    "Based on the following relevant system logs, answer the user's natural language query.\n"
    "Be concise, helpful, and technically accurate.\n\n"
    'Query: "%s"\n\nLogs:\n%s\n\nAnswer:'
)


def incident_lookup(
    requests: DataFrame,
    incidents: DataFrame,
    threshold: float = REUSE_THRESHOLD,
    model: str = "model",
) -> DataFrame:
    """Every request with its most similar incident (``incident_id``,
    ``incident_score``), ``reused`` and, when reused, explanation and model."""
    best = nearest(
        incidents, requests, 1, id_col="incident_id", query_id="query_id", query_vector="query_vector"
    ).select(
        "query_id",
        "incident_id",
        F.col("score").alias("incident_score"),
        F.col("explanation").alias("__explanation"),
    )
    return (
        requests.join(best, "query_id", "left")
        .withColumn("reused", F.coalesce(F.col("incident_score") >= threshold, F.lit(False)))
        .withColumn("explanation", F.when(F.col("reused"), F.col("__explanation")))
        .withColumn("model", F.when(F.col("reused"), F.lit(f"{model} (cached)")).otherwise(F.lit(model)))
        .drop("__explanation")
    )


def retrieve_context(
    misses: DataFrame, logs: DataFrame, limit: int = DEFAULT_CONTEXT, scoped: bool = False
) -> DataFrame:
    """Ranked context logs of the requests no incident answers. With
    ``scoped``, a request's ``service_id`` (when set) restricts its context."""
    if not 1 <= limit <= MAX_CONTEXT:
        raise ValueError(f"context limit must be between 1 and {MAX_CONTEXT}")
    return nearest(logs, misses, limit, scope_col="service_id" if scoped else None)


def explain_prompts(requests: DataFrame, context: DataFrame) -> DataFrame:
    """One prompt per request: numbered context lines, then the error. Without
    context, only the error part. At most 20 lines meet per request."""
    line = F.struct(
        "rank",
        F.format_string(
            "[%s] %s (service: %s): %s",
            F.coalesce("level", F.lit("UNKNOWN")),
            F.coalesce(filled(F.col("timestamp")), F.lit("unknown time")),
            F.coalesce("service_id", F.lit("unknown_service")),
            F.coalesce("message", F.lit("")),
        ).alias("line"),
    )
    sections = context.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("__lines"))
    numbered = F.transform(
        "__lines", lambda entry, i: F.format_string("  [%d] %s", i + 1, entry["line"])
    )
    section = F.concat(F.lit("Context logs from the system:\n"), F.array_join(numbered, "\n"), F.lit("\n\n"))
    return (
        requests.join(sections, "query_id", "left")
        .withColumn(
            "prompt",
            F.concat(F.coalesce(section, F.lit("")), F.lit("Error to explain:\n"), F.col("error_message")),
        )
        .withColumn("context_logs", F.coalesce(F.size("__lines"), F.lit(0)))
        .drop("__lines")
    )


def search_prompts(answers: DataFrame, product: str = "this system", query: str = "query") -> DataFrame:
    """Answer prompt from a query text and its ``log_context``."""
    return answers.withColumn(
        "prompt", F.format_string(SEARCH_PROMPT, F.lit(product), F.col(query), F.col("log_context"))
    )


def complete(prompts: DataFrame, completer: Callable[[Column], Column], prompt: str = "prompt") -> DataFrame:
    """Run the caller's Arrow UDF (prompt to text) over the prompts."""
    return prompts.withColumn("explanation", strip(F.coalesce(completer(F.col(prompt)), F.lit(""))))


def new_incidents(explained: DataFrame) -> DataFrame:
    """Rows to remember: only those with an explanation. The id is a hash of
    the content, so a repeated run writes the same ids."""
    return (
        explained.filter(filled(F.col("explanation")).isNotNull())
        .withColumn("incident_id", F.sha2(F.concat_ws("\x1f", "error_message", "explanation", "service_id"), 256))
        .select("incident_id", "error_message", "explanation", "service_id", F.col("query_vector").alias("vector"))
    )
