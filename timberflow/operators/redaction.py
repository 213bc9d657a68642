"""Redaction over whole DataFrames: text, counts, summaries, detection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from timberflow.functions import redact as rx
from timberflow.operators.pinning import pin


def redact_column(
    df: DataFrame,
    column: str,
    rules: tuple[rx.Rule, ...] = rx.DEFAULT_RULES,
    counts: str | None = "redactions",
    enabled: bool = True,
) -> DataFrame:
    """Redact ``column`` in place and add a ``map<label, matches>`` column.

    Counts see the text as the earlier rules left it. The chain is a single
    expression whose steps are bound one by one, evaluated once per row even
    when its results are filtered. Labels without a match are left out.
    """
    if not enabled or not rules:
        empty = F.create_map().cast("map<string,int>")
        return df.withColumn(counts, empty) if counts else df
    if not counts:
        return df.withColumn(column, rx.redact_text(F.col(column), rules))
    staged = pin(df, {"__redacted": rx.redact_with_counts(F.col(column), rules)})
    pairs = F.arrays_zip(
        F.array(*[F.lit(rule.label) for rule in rules]).alias("key"), F.col("__redacted.hits").alias("value")
    )
    hits = F.map_from_entries(F.filter(pairs, lambda pair: pair["value"] > 0))
    return staged.withColumns({column: F.col("__redacted.text"), counts: hits}).drop("__redacted")


def redaction_summary(df: DataFrame, counts: str = "redactions") -> DataFrame:
    """Total matches per label."""
    return (
        # The outer form keeps the optimizer from testing the map a second time
        # below the explode.
        df.select(F.explode_outer(counts).alias("label", "hits"))
        .filter("label is not null")
        .groupBy("label")
        .agg(F.sum("hits").cast("bigint").alias("matches"), F.count("*").alias("texts"))
    )


def redaction_metrics(df: DataFrame, counts: str = "redactions") -> DataFrame:
    """One row: ``total_redactions`` (a rule that hit a text counts once,
    cards count per match), ``payloads_sanitized`` and ``total_matches``."""
    entries = F.map_entries(counts)
    rule_hits = F.aggregate(
        entries,
        F.lit(0),
        lambda acc, e: acc + F.when(e["key"] == "CREDIT_CARD", e["value"]).otherwise(F.lit(1)),
    )
    matches = F.aggregate(F.map_values(counts), F.lit(0), lambda acc, v: acc + v)
    return df.agg(
        F.coalesce(F.sum(rule_hits), F.lit(0)).cast("bigint").alias("total_redactions"),
        F.count_if(F.size(counts) > 0).alias("payloads_sanitized"),
        F.coalesce(F.sum(matches), F.lit(0)).cast("bigint").alias("total_matches"),
    )


def redact_struct(df: DataFrame, column: str, rules: tuple[rx.Rule, ...] = rx.DEFAULT_RULES) -> DataFrame:
    """Redact every string inside a struct, array or map column."""
    return df.withColumn(column, rx.redact_nested(F.col(column), df.schema[column].dataType, rules))


def redact_variant(df: DataFrame, column: str, rules: tuple[rx.Rule, ...] = rx.DEFAULT_RULES) -> DataFrame:
    """Redact the string leaves of an untyped VARIANT column.

    Leaves sit at unknown paths, so its JSON text goes through one Arrow batch
    function that decodes, redacts and encodes each string that is no key;
    everything else of the text, numbers included, stays as it is. Rows in
    whose text no rule's literals occur skip it. The test looks for literals
    only (a digit for card numbers), because JSON escapes before a match hide
    the word boundary that a whole pattern needs.
    """
    specs = [(rule.token, rule.pattern, rule.luhn) for rule in rules]

    @F.pandas_udf("string")
    def redact_leaves(texts: pd.Series) -> pd.Series:
        import json
        import re

        compiled = [(token, re.compile(pattern, re.ASCII), luhn) for token, pattern, luhn in specs]
        string = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?', re.DOTALL)

        def checksum(match_text: str) -> bool:
            digits = [int(ch) for ch in match_text if ch.isdigit()][::-1]
            doubled = [sum(divmod(2 * digit, 10)) for digit in digits[1::2]]
            return (sum(digits[0::2]) + sum(doubled)) % 10 == 0

        def clean(leaf: re.Match) -> str:
            if leaf.group(1):
                return leaf.group()
            text = json.loads(leaf.group(), strict=False)
            for token, regex, luhn in compiled:
                if luhn:
                    text = regex.sub(lambda m: token if checksum(m.group()) else m.group(), text)
                else:
                    text = regex.sub(lambda m: token, text)
            return json.dumps(text, ensure_ascii=False)

        return texts.map(lambda text: text if text is None else string.sub(clean, text))

    text = F.col("__text")
    suspicious = F.lit(False)
    for rule in rules:
        suspicious = suspicious | (text.rlike("[0-9]") if rule.luhn else rx.may_match(rule, text))
    return (
        pin(df, {"__text": F.to_json(F.col(column))})
        .withColumn("__clean", redact_leaves(F.when(suspicious, text)))
        .transform(
            lambda staged: pin(
                staged,
                {column: F.when(F.col("__clean").isNotNull(), F.try_parse_json("__clean")).otherwise(F.col(column))},
            )
        )
        .drop("__text", "__clean")
    )


def detected_fields(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per sensitive match: ``type, value, position``."""
    return df.select(*keep, F.explode(rx.sensitive_fields(F.col(column))).alias("hit")).select(
        *keep, "hit.type", "hit.value", "hit.position"
    )


def detection_report(df: DataFrame, column: str) -> DataFrame:
    """Per text: length, number of matches, matches per type, severity."""
    kinds = F.transform("__fields", lambda field: field["type"])
    per_type = F.map_from_entries(
        F.transform(
            F.array_distinct(kinds),
            lambda kind: F.struct(kind, F.size(F.filter(kinds, lambda other: other == kind))),
        )
    )
    return (
        pin(df, {"__fields": rx.sensitive_fields(F.col(column))})
        .withColumn("text_length", F.length(column))
        .withColumn("sensitive_fields_found", F.size("__fields"))
        .withColumn("field_types", per_type)
        .withColumn("severity", F.when(F.size("__fields") > 0, "high").otherwise("low"))
        .drop("__fields")
    )
