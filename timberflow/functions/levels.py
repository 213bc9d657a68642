"""Severity level expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from timberflow.functions.text import non_empty, strip

# The level vocabularies.
LINE_LEVELS = ("INFO", "WARN", "WARNING", "ERROR", "DEBUG", "CRITICAL")
RECORD_LEVELS = LINE_LEVELS + ("TRACE", "FATAL")
ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL")
SEVERITY_BANDS = (
    (1, 4, "TRACE"),
    (5, 8, "DEBUG"),
    (9, 12, "INFO"),
    (13, 16, "WARN"),
    (17, 20, "ERROR"),
    (21, 24, "FATAL"),
)


def _known(upper: Column, vocabulary: tuple[str, ...]) -> Column:
    return (
        F.when(upper == "WARNING", "WARN")
        .when(upper.isin(*vocabulary), upper)
        .otherwise("INFO")
    )


def line_level(level: Column) -> Column:
    """Level of a parsed line: upper-cased but not trimmed; TRACE and FATAL
    are unknown here and become INFO."""
    return _known(F.upper(level), LINE_LEVELS)


def record_level(level: Column) -> Column:
    """Level of a structured record: trimmed, TRACE and FATAL kept."""
    return _known(strip(F.upper(level)), RECORD_LEVELS)


def severity_number_level(number: Column) -> Column:
    """OpenTelemetry severity number (any type) to a level name."""
    value = number.try_cast("int")
    level = F.lit("INFO")
    for low, high, name in reversed(SEVERITY_BANDS):
        level = F.when(value.between(low, high), name).otherwise(level)
    return level


def otel_level(severity_text: Column, severity_number: Column) -> Column:
    """Severity text wins when it is not blank, then the number, then INFO."""
    return F.coalesce(
        non_empty(F.upper(strip(severity_text))),
        severity_number_level(severity_number),
    )


def inferred_severity(text: Column) -> Column:
    """Guess the severity from words in free text."""
    lowered = F.lower(text)

    def mentions(*words: str) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(lowered, F.lit(word))
        return found

    return (
        F.when(mentions("critical", "fatal"), "critical")
        .when(mentions("error", "exception", "failure"), "error")
        .when(mentions("warn", "rate limit"), "warn")
        .otherwise("info")
    )
