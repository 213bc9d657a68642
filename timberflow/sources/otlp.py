"""OpenTelemetry log payloads (OTLP as JSON text)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from timberflow.functions.levels import otel_level
from timberflow.functions.redact import DEFAULT_RULES, Rule, redact_map
from timberflow.functions.services import resolve_service_id
from timberflow.functions.text import let, non_empty
from timberflow.functions.timestamps import event_time, nanos_text
from timberflow.operators.parsing import parse_lines
from timberflow.operators.pinning import pin
from timberflow.operators.redaction import redact_column
from timberflow.schema import stable_id

# Parts of unknown shape stay VARIANT, so a malformed one is skipped alone.
_ATTRIBUTES = "array<struct<key:string,value:variant>>"
# Levels of lists that expressions decode; deeper ones wait as wire form between
# two characters that JSON text never holds unescaped.
_LEVELS = 1
_OPEN, _CLOSE = "\x00", "\x01"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _quoted(text: Column) -> Column:
    """JSON string literal of a text."""
    return F.to_json(text.cast("variant"))


def any_value_json(value: Column, depth: int = _LEVELS) -> Column:
    """JSON text of an OTLP AnyValue. Lists and key-value lists more than
    ``depth`` levels down stay marked wire form, for :func:`decode_marked`."""
    integer = _at(value, "$.intValue", "string")
    real = _at(value, "$.doubleValue", "string")
    out = (
        F.when(value.isNull() | (_kind(value) == "VOID"), F.lit("null"))
        .when(_at(value, "$.stringValue").isNotNull(), F.to_json(_at(value, "$.stringValue")))
        .when(_at(value, "$.boolValue").isNotNull(), F.to_json(_at(value, "$.boolValue")))
        .when(
            integer.isNotNull(),
            F.coalesce(integer.try_cast("bigint").cast("string"), _quoted(integer)),
        )
        .when(real.isNotNull(), F.coalesce(real.try_cast("double").cast("string"), _quoted(real)))
    )
    is_list = _at(value, "$.arrayValue").isNotNull()
    is_map = _at(value, "$.kvlistValue").isNotNull()
    if depth <= 0:
        marked = F.concat(F.lit(_OPEN), F.to_json(value), F.lit(_CLOSE))
        return out.when(is_list | is_map, marked).otherwise(F.to_json(value))

    # Lists and key-value lists share one recursion: a list item is an entry
    # without a key.
    items = F.coalesce(
        _at(value, "$.arrayValue.values", "array<variant>"), _at(value, "$.arrayValue", "array<variant>")
    )
    pairs = F.coalesce(
        _at(value, "$.kvlistValue.values", _ATTRIBUTES), _at(value, "$.kvlistValue", _ATTRIBUTES)
    )
    unkeyed = F.transform(items, lambda item: F.struct(F.lit(None).cast("string").alias("key"), item.alias("value")))
    entries = F.when(is_list, unkeyed).otherwise(F.filter(pairs, lambda entry: entry["key"].isNotNull()))
    decoded = F.transform(
        entries,
        lambda entry: F.concat(
            F.coalesce(F.concat(_quoted(entry["key"]), F.lit(":")), F.lit("")),
            any_value_json(entry["value"], depth - 1),
        ),
    )
    inside = F.coalesce(F.array_join(decoded, ","), F.lit(""))
    return (
        out.when(is_list, F.concat(F.lit("["), inside, F.lit("]")))
        .when(is_map, F.concat(F.lit("{"), inside, F.lit("}")))
        # A plain value is its own JSON.
        .otherwise(F.to_json(value))
    )


def json_as_text(encoded: Column) -> Column:
    """Unquote a JSON string; other JSON stays as it is and null is null."""
    return F.when(
        encoded.startswith('"'), F.try_parse_json(encoded).try_cast("string")
    ).when(encoded != "null", encoded)


def _scalar_text(value: Column) -> list[Column]:
    """Texts of the scalar forms, at most one of which is not null. They cover
    nearly all values without encoding and reading JSON."""
    integer = _at(value, "$.intValue", "string")
    real = _at(value, "$.doubleValue", "string")
    return [
        _at(value, "$.stringValue", "string"),
        F.when(integer.isNotNull(), F.coalesce(integer.try_cast("bigint").cast("string"), integer)),
        F.when(real.isNotNull(), F.coalesce(real.try_cast("double").cast("string"), real)),
    ]


def _quote(text: str) -> str:
    return re.sub(r"\\u00..", lambda found: "\\u" + found[0][2:].upper(), json.dumps(text, ensure_ascii=False))


class _Number(str):
    """A JSON number as it is written."""


def _plain(value) -> str:
    """JSON text of a parsed value, numbers as they were written."""
    if isinstance(value, _Number):
        return value
    if isinstance(value, str):
        return _quote(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_plain, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quote(k)}:{_plain(v)}" for k, v in value.items()) + "}"
    return json.dumps(value)


def _real(text: str) -> str | None:
    """A number as the engine writes doubles: plain from 0.001 up to ten
    million, else with an exponent."""
    try:
        number = float(text)
    except ValueError:
        return None
    if number != number or number in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(number)]
    if number == 0 or 1e-3 <= abs(number) < 1e7:
        return repr(number) if "e" not in repr(number) else f"{number:f}"
    digits, power = f"{float(repr(number)):e}".split("e")
    digits = re.sub(r"\.", "", repr(abs(number)).split("e")[0]).strip("0") or "0"
    return f"{'-' if number < 0 else ''}{digits[0]}.{digits[1:] or '0'}E{int(power)}"


def _whole(text: str) -> str | None:
    if not re.fullmatch(r"\s*[+-]?[0-9]+\s*", text):
        return None
    number = int(text)
    return str(number) if -(1 << 63) <= number < 1 << 63 else None


def _any_value(value) -> str:
    """JSON text of a parsed AnyValue, nested to any depth; the same rules as
    :func:`any_value_json`."""
    if not isinstance(value, dict):
        return _plain(value)
    for name in ("stringValue", "boolValue"):
        if name in value:
            return _plain(value[name])
    for name, read in (("intValue", _whole), ("doubleValue", _real)):
        if value.get(name) is not None:
            text = value[name] if isinstance(value[name], str) else _plain(value[name])
            return read(text) or _quote(text)
    for name in ("arrayValue", "kvlistValue"):
        if name in value:
            inside = value[name]
            if isinstance(inside, dict):
                inside = inside.get("values")
            entries = inside if isinstance(inside, list) else []
            if name == "arrayValue":
                return "[" + ",".join(map(_any_value, entries)) + "]"
            return "{" + _pairs(entries) + "}"
    return _plain(value)


def _pairs(entries: list) -> str:
    if not all(entry is None or isinstance(entry, dict) for entry in entries):
        return ""
    named = [(e["key"], e.get("value")) for e in entries if e and e.get("key") is not None]
    return ",".join(f"{_quote(k if isinstance(k, str) else _plain(k))}:{_any_value(v)}" for k, v in named)


def _decode_text(text: str | None) -> str | None:
    def decoded(found: re.Match) -> str:
        return _any_value(json.loads(found[1], parse_int=_Number, parse_float=_Number))

    return None if text is None else re.sub(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}", decoded, text)


@F.pandas_udf(ArrayType(StringType()))
def decode_marked(texts: pd.Series) -> pd.Series:
    """JSON texts with their marked parts decoded; null stays null."""
    return texts.map(lambda row: None if row is None else [_decode_text(text) for text in row])


def _split_marked(encoded: Column, shown) -> tuple[Column, Column]:
    """``shown(encoded)``, or what is left to decode; the other is null."""
    marked = encoded.contains(_OPEN)
    return F.when(~marked, shown(encoded)), F.when(marked, encoded)


def _entry_parts(value: Column, shown) -> Column:
    """A value as ``text``, or as marked JSON in ``rest``. Scalars are most
    values and take no encoding."""

    def both(encoded: Column) -> Column:
        text, rest = _split_marked(encoded, shown)
        return F.struct(text.alias("text"), rest.alias("rest"))

    def known(scalar: Column) -> Column:
        found = F.struct(scalar.alias("text"), F.lit(None).cast("string").alias("rest"))
        return F.when(scalar.isNotNull(), found).otherwise(let(any_value_json(value), both))

    return let(F.coalesce(*_scalar_text(value)), known)


def attribute_entries(attributes: Column) -> Column:
    """Attribute list to entries (key, part): text as it is, other values as
    JSON. A value that is not a list is ignored."""
    entries = F.filter(attributes, lambda entry: entry["key"].isNotNull())
    return F.transform(
        entries,
        lambda entry: F.struct(entry["key"].alias("key"), _entry_parts(entry["value"], json_as_text).alias("part")),
    )


def body_part(body: Column) -> Column:
    """Message text of a body; booleans print as True and False."""

    def shown(encoded: Column) -> Column:
        return F.when(encoded == "true", "True").when(encoded == "false", "False").otherwise(json_as_text(encoded))

    return _entry_parts(body, shown)


def with_texts(df: DataFrame, body: str, entries: str, value: str, attributes: str) -> DataFrame:
    """``body`` (see :func:`body_part`) and ``entries`` to a text and a
    ``map<string,string>`` in which the last of equal keys wins. Only rows with
    marked parts send anything to Python."""
    parts = F.concat(F.array(F.col(body)), F.transform(entries, lambda entry: entry["part"]))
    df = pin(df, {"__parts": parts})
    rest = F.transform("__parts", lambda part: part["rest"])
    df = df.withColumn("__deep", decode_marked(F.when(F.exists("__parts", lambda part: part["rest"].isNotNull()), rest)))
    nothing = F.transform("__parts", lambda _part: F.lit(None).cast("string"))
    texts = F.zip_with("__parts", F.coalesce("__deep", nothing), lambda part, deep: F.coalesce(part["text"], deep))
    df = pin(df, {"__texts": texts})
    pairs = F.transform(entries, lambda entry, at: F.struct(entry["key"].alias("key"), F.get("__texts", at + 1).alias("value")))
    return pin(
        df,
        {
            value: F.coalesce(F.get("__texts", F.lit(0)), F.lit("")),
            attributes: F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>")),
        },
    ).drop("__parts", "__deep", "__texts", body, entries)


def flatten_payloads(df: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """One row per log record of each payload (``record_id``, JSON in
    ``value``): ``timestamp, level, message, metadata_kv, parser_type, raw``.

    A record's attributes override its resource's. A body in the bracketed or
    JSON line form is parsed, and what it says wins. ``ingest_time`` (text)
    stands in for a missing time, so that a run can be repeated.
    """
    missing = F.lit(None).cast("string") if ingest_time is None else ingest_time
    items = lambda column, path: F.try_variant_get(column, path, "array<variant>")
    payload = pin(df, {"__payload": F.try_parse_json("value")})
    # Non-lists become null and explode to nothing; list elements that are not
    # objects give null below and are skipped.
    resources = payload.select(
        "record_id", F.posexplode(items(F.col("__payload"), "$.resourceLogs")).alias("__r", "__resource")
    )
    scopes = resources.select(
        "record_id",
        "__r",
        F.try_variant_get("__resource", "$.resource.attributes", _ATTRIBUTES).alias("__resource_attrs"),
        F.posexplode(items(F.col("__resource"), "$.scopeLogs")).alias("__s", "__scope"),
    )
    records = scopes.select(
        "record_id",
        "__r",
        "__s",
        "__resource_attrs",
        F.posexplode(items(F.col("__scope"), "$.logRecords")).alias("__l", "__record"),
    ).filter(_kind(F.col("__record")).startswith("OBJECT"))
    record = F.col("__record")
    nanos = F.coalesce(
        F.nullif(F.col("__nanos"), F.lit("0")), _at(record, "$.observedTimeUnixNano", "string")
    )
    severity = _at(record, "$.severityText")
    records = pin(records, {"__body": _at(record, "$.body"), "__nanos": _at(record, "$.timeUnixNano", "string")})
    decoded = pin(
        records,
        {
            "__said": body_part(F.col("__body")),
            "__level": otel_level(
                F.when(_kind(severity) == "STRING", _at(record, "$.severityText", "string")),
                _at(record, "$.severityNumber", "string"),
            ),
            "__time": nanos_text(non_empty(nanos), missing),
            # The record's entries come last and win.
            "__entries": attribute_entries(
                F.concat(
                    F.coalesce("__resource_attrs", F.array().cast(_ATTRIBUTES)),
                    F.coalesce(F.try_variant_get(record, "$.attributes", _ATTRIBUTES), F.array().cast(_ATTRIBUTES)),
                )
            ),
            "record_id": F.concat_ws("/", "record_id", "__r", "__s", "__l"),
        },
    )
    decoded = with_texts(decoded, "__said", "__entries", "value", "__attrs")
    named = F.coalesce(
        non_empty(F.try_element_at("__attrs", F.lit("service.name"))),
        non_empty(F.try_element_at("__attrs", F.lit("service"))),
    )
    with_service = F.when(
        named.isNotNull(), F.map_concat(F.col("__attrs"), F.create_map(F.lit("service"), named))
    ).otherwise(F.col("__attrs"))
    decoded = pin(decoded, {"__attrs": with_service})
    parsed = parse_lines(decoded)
    return parsed.select(
        "record_id",
        F.coalesce(non_empty(F.col("timestamp")), F.col("__time")).alias("timestamp"),
        F.coalesce("level", "__level").alias("level"),
        F.coalesce(non_empty(F.col("message")), F.col("value")).alias("message"),
        F.map_concat(
            F.col("__attrs"), F.coalesce("metadata_kv", F.create_map().cast("map<string,string>"))
        ).alias("metadata_kv"),
        F.coalesce("parser_type", F.lit("otlp_log")).alias("parser_type"),
        F.col("value").alias("raw"),
    )


def otlp_logs(
    df: DataFrame, ingest_time: Column | None = None, rules: tuple[Rule, ...] = DEFAULT_RULES
) -> DataFrame:
    """OTLP payloads to canonical rows: flattened, service resolved, redacted.
    ``raw`` is the redacted message."""
    flat = flatten_payloads(df, ingest_time)
    flat = pin(flat, {name: F.col(name) for name in ("timestamp", "message", "metadata_kv")})
    resolved = pin(flat, {"service_id": resolve_service_id({}, F.col("metadata_kv"))})
    full_map = F.map_concat(
        F.create_map(F.lit("service"), F.col("service_id")),
        F.col("metadata_kv"),
        F.create_map(F.lit("service_id"), F.col("service_id")),
    )
    tagged = pin(resolved, {"metadata_kv": full_map}).withColumn("service", F.try_element_at("metadata_kv", F.lit("service")))
    redacted = redact_column(tagged, "message", rules).withColumn("raw", F.col("message"))
    return (
        pin(redacted, {"metadata_kv": redact_map(F.col("metadata_kv"), rules) if rules else F.col("metadata_kv")})
        .withColumns(
            {
                "metadata": F.to_variant_object("metadata_kv"),
                "environment": F.try_element_at("metadata_kv", F.lit("environment")),
                "ts": event_time(F.col("timestamp")),
                "log_id": stable_id(F.col("record_id")),
                "reject_reason": F.lit(None).cast("string"),
            }
        )
    )
