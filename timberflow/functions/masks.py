"""Log text normalisation before embedding and duplicate grouping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from timberflow.functions.text import let, non_empty, strip

# What is masked, in this order. The literal in front is a cheap
# test every match must pass, so most texts never reach the expression.
MASKS = (
    ("-", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (":", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<timestamp>"),
    (".", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    ("@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (None, r"\b\d+\b", "<number>"),
)
_MESSAGE_KEYS = ("message", "msg", "content")


def variant_text(value: Column, path: str) -> Column:
    """Text at ``path`` of a VARIANT, null where Python would call it false
    (missing, null, "", 0, false, [] or {})."""
    text = F.try_variant_get(value, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    hollow = text.isin("0", "0.0", "-0.0", "false", "[]", "{}") & (kind != "STRING")
    return F.when(~F.coalesce(hollow, F.lit(False)), non_empty(text))


def message_of_json(stripped: Column) -> Column:
    """For a text that is a JSON object, its message (or, without one, the
    object with sorted keys); any other text unchanged."""
    parsed = F.try_parse_json(stripped)
    inner = F.coalesce(
        *[variant_text(parsed, f"$.{key}") for key in _MESSAGE_KEYS], F.to_json(parsed), stripped
    )
    return F.when(stripped.startswith("{") & stripped.endswith("}"), inner).otherwise(stripped)


def mask_text(text: Column) -> Column:
    for trigger, pattern, token in MASKS:
        if trigger is None:
            text = F.regexp_replace(text, pattern, token)
            continue
        text = let(
            text,
            lambda t, trigger=trigger, pattern=pattern, token=token: F.when(
                F.contains(t, F.lit(trigger)), F.regexp_replace(t, pattern, token)
            ).otherwise(t),
        )
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized_text(column: Column, metadata_json: Column | None = None) -> Column:
    """Masked text without ids, times, addresses and numbers. A blank text is
    replaced by the metadata's JSON when that is given."""
    stripped = strip(F.coalesce(column, F.lit("")))
    if metadata_json is not None:
        stripped = F.when(stripped == "", F.coalesce(metadata_json, F.lit(""))).otherwise(stripped)
    return mask_text(let(stripped, message_of_json))


def semantic_text(message: Column, level: Column, service: Column, metadata_json: Column | None = None) -> Column:
    """``level=… service=… message {metadata}``, masked: the text to embed."""
    parts = [
        F.concat(F.lit("level="), non_empty(level)),
        F.concat(F.lit("service="), non_empty(service)),
        non_empty(message),
    ]
    if metadata_json is not None:
        parts.append(F.when(metadata_json != "{}", non_empty(metadata_json)))
    return normalized_text(F.concat_ws(" ", *parts))
