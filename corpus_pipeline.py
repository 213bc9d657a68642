"""A training corpus from ``documents`` in five stages.

Each stage takes all documents that the one before it kept; its result is
written to the shared folder and read again. Models are trained on a bounded
sample of the labelled rows among a stage's own documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from timberflow.llm import decontaminate, quality, toxicity
from timberflow.llm.bpe import encode_texts
from timberflow.llm.near_dedup import drop_near_duplicates
from timberflow.plans.registry import table
from timberflow.session import prepare, stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def filtered(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], adds: tuple[str, ...], keep: str) -> DataFrame:
    """The rows of ``docs`` that ``judge`` adds columns to and ``keep`` holds
    for; columns of ``docs`` that have one of these names stay as they are."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in adds}
    judged = judge(docs.withColumnsRenamed(own)).filter(keep)
    return judged.select([F.col(own.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality model."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    adds = (*quality.RULES, "base_failed", "quality", "kept")
    return filtered(docs, lambda rows: quality.judge_quality(rows, model), adds, "kept")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return filtered(docs, lambda rows: toxicity.score_toxicity(rows, model), ("score", "predicted"), "predicted = 0")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles,
    similarity of 0.8 or more)."""
    return drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    items, space = table(spark, sf_dir, "benchmark"), decontaminate.fit_space(docs)
    return filtered(docs, lambda rows: decontaminate.mark_contaminated(rows, items, space), ("matches",), "size(matches) = 0")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and digests of the ids and of the
    decoded text."""
    return encode_texts(docs, TOKENIZER).select(
        "doc_id",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: Trained models and tokenizers have no SQL form; tests/llm compares the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
