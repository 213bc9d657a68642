"""Raw lines, structured records, batches and the choice between them.

Every function takes a DataFrame that may be streaming, with the input text in
``value`` and a unique ``record_id``. Rejected rows stay in the result with a
``reject_reason``; :func:`accepted` and :func:`rejects` part them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timberflow.functions.levels import record_level
from timberflow.functions.redact import DEFAULT_RULES, Rule, redact_map, redact_text
from timberflow.functions.services import resolve_service_id, valid_service_id
from timberflow.functions.text import is_blank, non_empty
from timberflow.functions.timestamps import event_time, normalize_timestamp
from timberflow.operators.parsing import parse_lines
from timberflow.operators.pinning import pin
from timberflow.operators.redaction import redact_column
from timberflow.schema import canonical, stable_id

_RECORD_FIELDS = ("timestamp", "level", "service_id", "service", "host", "message", "source", "metadata")
_TEXT_MAP = "map<string,string>"
EMPTY_MESSAGE = "Log message cannot be empty"
BAD_SERVICE = "service_id is required for structured log ingestion"


def accepted(df: DataFrame, *keep: str) -> DataFrame:
    return canonical(df.filter("reject_reason is null"), *keep)


def rejects(df: DataFrame) -> DataFrame:
    return df.filter("reject_reason is not null").select("record_id", "value", "reject_reason")


def _empty_map() -> Column:
    return F.create_map().cast(_TEXT_MAP)


def _with_default(metadata: Column, key: str, value: Column) -> Column:
    """Set ``key`` only where it is missing."""
    return F.map_concat(F.create_map(F.lit(key), value), metadata)


def _with_value(metadata: Column, key: str, value: Column) -> Column:
    return F.map_concat(metadata, F.create_map(F.lit(key), value))


def _finish(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Redacted metadata, typed time, environment and id."""
    clean = pin(df, {"metadata_kv": redact_map(F.col("metadata_kv"), rules)}) if rules else df
    return clean.withColumns(
        {
            "ts": event_time(F.col("timestamp")),
            "log_id": stable_id(F.col("record_id")),
            "metadata": F.to_variant_object("metadata_kv"),
            "environment": F.try_element_at("metadata_kv", F.lit("environment")),
        }
    )


def raw_lines(
    df: DataFrame,
    service_id: str | None = None,
    metadata: str | None = None,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
) -> DataFrame:
    """Raw lines: redact, parse, fall back to the line itself.

    ``service_id`` and ``metadata`` name request-level columns; request
    metadata wins over what the line says. Blank lines and malformed request
    services are rejected.
    """
    request = F.coalesce(F.col(metadata), _empty_map()) if metadata else _empty_map()
    candidate = F.coalesce(
        *([non_empty(F.col(service_id))] if service_id else []),
        F.try_element_at(request, F.lit("service")),
        F.try_element_at(request, F.lit("service_id")),
    )
    own = valid_service_id(candidate)
    base = F.when(own.isNotNull(), _with_default(_with_value(request, "service_id", own), "service", own)).otherwise(request)
    staged = pin(
        df,
        {
            "__base": base,
            "reject_reason": F.when(is_blank(F.col("value")), EMPTY_MESSAGE).when(
                candidate.isNotNull() & own.isNull(), "service_id is malformed"
            ),
        },
    ).withColumn("__text", F.col("value"))
    parsed = parse_lines(redact_column(staged, "__text", rules), "__text")
    parsed = pin(parsed, {"metadata_kv": F.coalesce("metadata_kv", _empty_map())})
    found = F.col("parser_type").isNotNull()
    line_map = F.col("metadata_kv")
    resolved = pin(parsed, {"__merged": F.map_concat(line_map, F.col("__base"))})
    resolved = pin(resolved, {"service_id": resolve_service_id({}, line_map, F.col("__merged"))})
    full_map = _with_default(
        _with_value(F.col("__merged"), "service_id", F.col("service_id")), "service", F.col("service_id")
    )
    complete = pin(
        resolved,
        {
            "level": F.coalesce("level", F.lit("INFO")),
            "message": F.when(found, F.col("message")).otherwise(F.col("__text")),
            "raw": F.when(found, F.col("raw")).otherwise(F.col("__text")),
            "parser_type": F.coalesce("parser_type", F.lit("raw_input")),
            "metadata_kv": full_map,
            "service": F.coalesce(F.try_element_at("__merged", F.lit("service")), F.col("service_id")),
        },
    )
    return _finish(complete, rules).drop(
        "__base", "__text", "__merged", "is_empty", "is_malformed_json", "timestamp_failed"
    )


def structured_records(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """JSON records with a required message and a resolvable service; unknown
    keys are folded into the metadata."""
    fields = F.from_json("value", "map<string,string>")
    get = lambda name: F.try_element_at("__fields", F.lit(name))
    extras = F.map_filter("__fields", lambda key, _value: ~key.isin(*_RECORD_FIELDS))
    staged = pin(df, {"__fields": fields})
    nested = F.coalesce(F.from_json(get("metadata"), _TEXT_MAP), _empty_map())
    staged = pin(staged, {"__meta": F.map_concat(nested, extras)})
    staged = pin(
        staged,
        {
            "timestamp": get("timestamp"),
            "level": record_level(get("level")),
            "host": get("host"),
            "source": get("source"),
            "message": get("message"),
            "service_id": resolve_service_id(
                {"service_id": get("service_id"), "service": get("service")}, F.col("__meta"), default=None
            ),
        },
    )
    staged = pin(
        staged,
        {
            "reject_reason": F.when(F.col("__fields").isNull(), "not a JSON object")
            .when(is_blank(F.col("message")), EMPTY_MESSAGE)
            .when(F.col("service_id").isNull(), BAD_SERVICE),
            "service": F.coalesce(non_empty(get("service")), F.col("service_id")),
            "timestamp": F.coalesce(normalize_timestamp(F.col("timestamp")), F.col("timestamp")),
            "raw": redact_text(F.col("value"), rules),
            "parser_type": F.lit("structured_input"),
        },
    )
    known = F.map_filter(
        F.create_map(
            F.lit("service_id"), F.col("service_id"), F.lit("host"), non_empty(F.col("host")), F.lit("source"), non_empty(F.col("source"))
        ),
        lambda _key, value: value.isNotNull(),
    )
    # Rejected rows may lack a service; their metadata is not used.
    staged = staged.withColumn(
        "metadata_kv",
        F.when(
            F.col("reject_reason").isNull(),
            _with_default(F.map_concat(F.col("__meta"), known), "service", F.col("service")),
        ),
    )
    return _finish(redact_column(staged, "message", rules), rules).drop("__fields", "__meta")


def batch_records(df: DataFrame) -> DataFrame:
    """Unpack ``{"logs": [...]}`` payloads: one row per record with
    ``batch_id, record_index, value, record_id``. A payload without records
    yields no rows; see :func:`batch_errors`."""
    logs = F.from_json("value", "logs array<string>")["logs"]
    return (
        df.withColumn("__logs", logs)
        .filter(F.size("__logs") > 0)
        .select(
            F.col("record_id").alias("batch_id"), F.posexplode("__logs").alias("record_index", "value")
        )
        .withColumn("record_id", F.concat_ws("/", "batch_id", "record_index"))
    )


def batch_errors(df: DataFrame) -> DataFrame:
    size = F.coalesce(F.size(F.from_json("value", "logs array<string>")["logs"]), F.lit(-1))
    return df.filter(size < 1).select("record_id", "value", F.lit("a batch holds at least one record").alias("reject_reason"))


def batch_report(records: DataFrame) -> DataFrame:
    """Per batch: processed and failed records, the failures, status and summed
    redaction counts. A batch arrives as one payload, which bounds its failure
    list."""
    failed = F.col("reject_reason").isNotNull()
    # Per record an entry without a label, which counts it, and one per label:
    # so one pass over the records gives counts, failures and sums.
    entry = lambda label, hits: F.struct(label.cast("string").alias("label"), hits.cast("bigint").alias("hits"))
    found = F.when(~failed, F.transform(F.map_entries("redactions"), lambda e: entry(e["key"], e["value"])))
    failure = F.when(failed, F.struct("record_index", F.col("reject_reason").alias("error")))
    entries = F.concat(F.array(entry(F.lit(None), F.lit(0))), F.coalesce(found, F.array()))
    own = F.col("label").isNull()
    labelled = (
        records.select("batch_id", failure.alias("failure"), F.inline(entries))
        .groupBy("batch_id", "label")
        .agg(
            F.count_if(own & F.col("failure").isNull()).alias("processed"),
            F.count_if(own & F.col("failure").isNotNull()).alias("failed"),
            F.collect_list(F.when(own, F.col("failure"))).alias("failures"),
            F.sum("hits").alias("hits"),
        )
    )
    sums = F.collect_list(F.when(~own & F.col("batch_id").isNotNull(), F.struct("label", "hits")))
    return labelled.groupBy("batch_id").agg(
        F.sum("processed").alias("processed_records"),
        F.sum("failed").alias("failed_records"),
        F.array_sort(F.flatten(F.collect_list("failures"))).alias("failures"),
        F.map_from_entries(F.array_sort(sums)).alias("redaction_summary"),
    ).withColumn("status", F.when(F.col("failed_records") == 0, "success").otherwise("partial_success"))


def payload_form(df: DataFrame) -> DataFrame:
    """Adds ``form``: batch, raw, structured, or ambiguous / invalid (with
    ``reject_reason``), from the keys of the JSON payload."""
    keys = F.json_object_keys("value")
    has_logs, has_line = F.array_contains(keys, "logs"), F.array_contains(keys, "log_data")
    return df.withColumn(
        "form",
        F.when(keys.isNull(), "invalid")
        .when(has_logs & has_line, "ambiguous")
        .when(has_logs, "batch")
        .when(has_line, "raw")
        .otherwise("structured"),
    ).withColumn(
        "reject_reason",
        F.when(F.col("form") == "invalid", "not a JSON object").when(
            F.col("form") == "ambiguous", "Ambiguous payload: cannot contain both 'logs' and 'log_data'"
        ),
    )


def ingest_payloads(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Any mix of payload forms to canonical rows (plus ``record_id``,
    ``value`` and ``reject_reason``)."""
    forms = payload_form(df)
    keep = ("record_id", "value", "reject_reason")

    def of(form: str) -> DataFrame:
        return forms.filter(F.col("form") == form).drop("form", "reject_reason")

    fields = F.from_json("value", _TEXT_MAP)
    payload = pin(of("raw"), {"__payload": fields})
    raw = pin(
        payload,
        {
            "value": F.col("__payload")["log_data"],
            "request_service": F.coalesce(
                non_empty(F.try_element_at("__payload", F.lit("service_id"))),
                non_empty(F.try_element_at("__payload", F.lit("service"))),
            ),
            "request_metadata": F.map_concat(
                F.coalesce(F.from_json(F.try_element_at("__payload", F.lit("metadata")), _TEXT_MAP), _empty_map()),
                F.map_filter(
                    "__payload", lambda key, _value: ~key.isin("log_data", "service_id", "service", "metadata")
                ),
            ),
        },
    ).drop("__payload")
    parts = [
        canonical(structured_records(of("structured"), rules), *keep),
        canonical(structured_records(batch_records(of("batch")).drop("batch_id", "record_index"), rules), *keep),
        canonical(raw_lines(raw, "request_service", "request_metadata", rules), *keep),
    ]
    bad = forms.filter("reject_reason is not null").unionByName(
        batch_errors(of("batch")).withColumn("form", F.lit("batch"))
    )
    parts.append(canonical(bad.select(*keep), *keep))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def explanation_fields(message: Column) -> Column:
    """The fixed answer fields shown for a log."""
    return F.struct(
        F.concat(F.lit("Detected issue in logs: "), F.substring(message, 1, 120)).alias("Problem Summary"),
        F.lit("System error, timeout, invalid request, or service failure.").alias("Possible Cause"),
        F.lit("Backend ingestion pipeline / API / service layer").alias("Affected Component"),
        F.lit("Check logs, validate input, monitor service health, and retry request.").alias("Suggested Fix"),
    )
