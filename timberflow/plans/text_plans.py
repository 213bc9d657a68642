"""Redaction and normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberflow.functions import levels as L, masks as M, redact as R, services as S, timestamps as T, vectors as V
from timberflow.functions.text import escape_markup
from timberflow.operators import redaction as RD
from timberflow.plans.registry import EVENT_LOGS, document_logs, event_logs, query, spread, table
from timberflow.sources.records import explanation_fields


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# SQL for "the digits of this card-shaped text pass the checksum".
_LUHN = """(list_sum(list_transform(range(1, 1 + length(regexp_replace({h}, '\\D', '', 'g'))),
  lambda i: CASE WHEN (length(regexp_replace({h}, '\\D', '', 'g')) - i) % 2 = 1
    THEN (2 * CAST(substr(regexp_replace({h}, '\\D', '', 'g'), i, 1) AS INT)) % 10
       + (2 * CAST(substr(regexp_replace({h}, '\\D', '', 'g'), i, 1) AS INT)) // 10
    ELSE CAST(substr(regexp_replace({h}, '\\D', '', 'g'), i, 1) AS INT) END)) % 10 = 0)"""


def _stitched(text: str, pattern: str, rewrite: str) -> str:
    """SQL: cut at the matches, rewrite each ({h} is the match), stitch."""
    hit = f"regexp_extract_all({text}, {_quote(pattern)})[i]"
    return (
        f"array_to_string(list_transform(range(1, 1 + len(string_split_regex({text}, {_quote(pattern)}))), "
        f"lambda i: string_split_regex({text}, {_quote(pattern)})[i] || "
        f"coalesce({rewrite.replace('{h}', hit)}, '')), '')"
    )


def _redaction_sql(rules, source="SELECT doc_id, text AS t0 FROM documents") -> str:
    steps = [f"s0 AS ({source})"]
    for n, rule in enumerate(rules):
        pattern = _quote(rule.pattern)
        if rule.luhn:
            luhn = _LUHN.replace("{h}", "h")
            count = f"len(list_filter(regexp_extract_all(t{n}, {pattern}), lambda h: {luhn}))"
            inner = _LUHN.replace("{h}", "{h}").replace("lambda i:", "lambda j:").replace("- i)", "- j)").replace(", i, 1)", ", j, 1)")
            replaced = _stitched(
                f"t{n}", rule.pattern, "CASE WHEN {h} IS NULL THEN '' WHEN " + inner + f" THEN '{rule.token}' ELSE {{h}} END"
            )
            replaced = f"CASE WHEN regexp_matches(t{n}, {pattern}) THEN {replaced} ELSE t{n} END"
        else:
            count = f"len(regexp_extract_all(t{n}, {pattern}))"
            replaced = f"regexp_replace(t{n}, {pattern}, '{rule.token}', 'g')"
        steps.append(f"s{n + 1} AS (SELECT *, {count} AS n_{rule.label.lower()}, {replaced} AS t{n + 1} FROM s{n})")
    return "WITH " + ",\n".join(steps)


_ALL_RULES = R.select_rules(include_ipv4=True)
_REDACTED = _redaction_sql(_ALL_RULES)
_LABELS = [rule.label for rule in _ALL_RULES]
_LAST = f"s{len(_ALL_RULES)}"
_FINAL = f"t{len(_ALL_RULES)}"


def redacted_documents(spark, sf_dir):
    return RD.redact_column(spread(table(spark, sf_dir, "documents")), "text", _ALL_RULES)


@query(
    "redact_documents",
    _REDACTED + f" SELECT doc_id, md5({_FINAL}) AS text_md5, length({_FINAL}) AS n_chars FROM {_LAST}",
)
def redact_documents(spark, sf_dir):
    text = F.col("text")
    clean = R.redact_text(text, _ALL_RULES)
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", clean.alias("text"))
    return rows.select("doc_id", F.md5(text).alias("text_md5"), F.length(text).cast("bigint").alias("n_chars"))


@query(
    "redaction_counts",
    _REDACTED
    + " UNION ALL ".join(
        f" SELECT doc_id, '{label}' AS label, n_{label.lower()} AS matches FROM {_LAST} WHERE n_{label.lower()} > 0"
        for label in _LABELS
    ),
)
def redaction_counts(spark, sf_dir):
    counts = redacted_documents(spark, sf_dir).select("doc_id", F.explode_outer("redactions").alias("label", "matches"))
    return counts.filter("label is not null")


@query(
    "redaction_summary",
    _REDACTED
    + " SELECT label, CAST(sum(n) AS BIGINT) AS matches, count(*) AS texts FROM ("
    + " UNION ALL ".join(f"SELECT '{label}' AS label, n_{label.lower()} AS n FROM {_LAST}" for label in _LABELS)
    + ") WHERE n > 0 GROUP BY label",
)
def redaction_summary(spark, sf_dir):
    return RD.redaction_summary(redacted_documents(spark, sf_dir))


_HITS = " + ".join(
    f"n_{label.lower()}" if label == "CREDIT_CARD" else f"CAST(n_{label.lower()} > 0 AS INT)" for label in _LABELS
)
_TOTAL = " + ".join(f"n_{label.lower()}" for label in _LABELS)


@query(
    "redaction_metrics",
    _REDACTED
    + f""" SELECT CAST(sum({_HITS}) AS BIGINT) AS total_redactions, count(*) FILTER ({_TOTAL} > 0) AS payloads_sanitized,
 CAST(sum({_TOTAL}) AS BIGINT) AS total_matches FROM {_LAST}""",
)
def redaction_metrics(spark, sf_dir):
    return RD.redaction_metrics(redacted_documents(spark, sf_dir))


_EMAIL_ONLY = R.select_rules(["email"])


@query(
    "redact_rule_subset",
    _redaction_sql(_EMAIL_ONLY) + " SELECT doc_id, md5(t1) AS text_md5 FROM s1",
)
def redact_rule_subset(spark, sf_dir):
    text = R.redact_text(F.col("text"), _EMAIL_ONLY)
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(text).alias("text_md5"))


def _nested(spark, sf_dir):
    """Documents as nested payloads: text inside a struct, a list and a map."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id",
        F.struct(
            F.struct(F.col("text").alias("body"), F.col("n_chars").alias("size")).alias("inner"),
            F.array("text", "lang").alias("items"),
            F.create_map(F.lit("a@b.example"), F.col("text")).alias("tags"),
        ).alias("payload"),
    )


@query(
    "redact_nested_values",
    _redaction_sql(_EMAIL_ONLY)
    + """ SELECT doc_id, md5(t1) AS body_md5, md5(t1) AS item_md5, md5(t1) AS tag_md5,
 'a@b.example' AS tag_key FROM s1""",
)
def redact_nested_values(spark, sf_dir):
    clean = RD.redact_struct(_nested(spark, sf_dir), "payload", _EMAIL_ONLY)
    return clean.select(
        "doc_id",
        F.md5("payload.inner.body").alias("body_md5"),
        F.md5(F.col("payload.items")[0]).alias("item_md5"),
        F.md5(F.map_values("payload.tags")[0]).alias("tag_md5"),
        F.map_keys("payload.tags")[0].alias("tag_key"),
    )


@query(
    "redact_variant_values",
    _redaction_sql(R.DEFAULT_RULES) + f" SELECT doc_id, md5(t{len(R.DEFAULT_RULES)}) AS body_md5, 'a@b.example' AS tag_key FROM s{len(R.DEFAULT_RULES)}",
)
def redact_variant_values(spark, sf_dir):
    untyped = _nested(spark, sf_dir).withColumn("payload", F.try_parse_json(F.to_json("payload")))
    clean = RD.redact_variant(untyped, "payload")
    return clean.select(
        "doc_id",
        F.md5(F.try_variant_get("payload", "$.inner.body", "string")).alias("body_md5"),
        F.json_object_keys(F.to_json(F.try_variant_get("payload", "$.tags", "variant")))[0].alias("tag_key"),
    )


def _mask_steps(source: str) -> str:
    """Common table expressions m0 to m8: ``source`` (doc_id, t0) masked rule by
    rule."""
    steps = [f"m0 AS ({source})"]
    for n, (_kind, pattern, _trigger, grouped) in enumerate(R.SENSITIVE_PATTERNS):
        regex = "(?i)" + pattern
        hidden = f"regexp_extract({{h}}, {_quote(regex)}, 1)" if grouped else "{h}"
        body = _stitched(f"t{n}", regex, f"repeat('*', length({hidden}))")
        steps.append(
            f"m{n + 1} AS (SELECT doc_id, CASE WHEN regexp_matches(t{n}, {_quote(regex)}) THEN {body} ELSE t{n} END AS t{n + 1} FROM m{n})"
        )
    return ",\n".join(steps)


def _mask_sql() -> str:
    return "WITH " + _mask_steps("SELECT doc_id, text AS t0 FROM documents")


@query("mask_sensitive", _mask_sql() + " SELECT doc_id, md5(t8) AS text_md5 FROM m8")
def mask_sensitive(spark, sf_dir):
    masked = R.mask_sensitive(F.col("text"))
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", masked.alias("text"))
    return rows.select("doc_id", F.md5("text").alias("text_md5"))


def _fields_sql() -> str:
    parts = []
    for kind, pattern, _trigger, _grouped in R.SENSITIVE_PATTERNS:
        regex = _quote("(?i)" + pattern)
        parts.append(
            f"""SELECT doc_id, '{kind}' AS type, hits[i] AS value,
  CAST(list_sum(list_transform(range(1, i + 1), lambda j: length(pieces[j])))
     + coalesce(list_sum(list_transform(range(1, i), lambda j: length(hits[j]))), 0) AS INT) AS position
FROM (SELECT doc_id, hits, pieces, unnest(range(1, 1 + len(hits))) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, {regex}) AS hits, string_split_regex(text, {regex}) AS pieces FROM documents))"""
        )
    return "WITH f AS (" + " UNION ALL ".join(parts) + ")"


@query("sensitive_fields", _fields_sql() + " SELECT doc_id, type, value, position FROM f")
def sensitive_fields(spark, sf_dir):
    return RD.detected_fields(spread(table(spark, sf_dir, "documents")), "text", "doc_id")


@query(
    "sensitive_report",
    _fields_sql()
    + """ SELECT d.doc_id, CAST(length(text) AS INT) AS text_length, CAST(coalesce(n, 0) AS INT) AS sensitive_fields_found,
 coalesce(types, '') AS field_types, CASE WHEN n > 0 THEN 'high' ELSE 'low' END AS severity
FROM documents d LEFT JOIN (
  SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, string_agg(type || '=' || c, ',' ORDER BY type) AS types
  FROM (SELECT doc_id, type, count(*) AS c FROM f GROUP BY ALL) GROUP BY doc_id) USING (doc_id)""",
)
def sensitive_report(spark, sf_dir):
    report = RD.detection_report(spread(table(spark, sf_dir, "documents")), "text")
    types = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("field_types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        ),
        ",",
    )
    return report.select("doc_id", "text_length", "sensitive_fields_found", types.alias("field_types"), "severity")


_STAMPS = """
SELECT log_id, CASE event_type
    WHEN 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
    WHEN 'purchase' THEN '  ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' '
    WHEN 'view' THEN CAST(epoch_us(ts) // 1000 AS VARCHAR)
    WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30'
    ELSE 'not a time ' || log_id END AS stamp,
  CASE event_type
    WHEN 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'
    WHEN 'purchase' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
    WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) // 1000 % 1000 = 0 THEN '' ELSE strftime(ts, '.%g') || '000' END || '+00:00'
    WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30'
    ELSE 'not a time ' || log_id END AS normalized,
  CASE event_type
    WHEN 'error' THEN epoch_us(ts)
    WHEN 'purchase' THEN epoch_us(ts) // 1000000 * 1000000
    WHEN 'view' THEN epoch_us(ts) // 1000 * 1000
    WHEN 'click' THEN epoch_us(ts) // 1000000 * 1000000 - 19800000000
    END AS ts_us
FROM logs"""


def stamped(spark, sf_dir):
    """Event times written in five layouts, by event type."""
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp")
    stamp = (
        F.when(kind == "error", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == "purchase", F.date_format(ts, "'  'yyyy-MM-dd HH:mm:ss' '"))
        .when(kind == "view", F.unix_millis(ts).cast("string"))
        .when(kind == "click", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+05:30'"))
        .otherwise(F.concat(F.lit("not a time "), F.col("log_id").cast("string")))
    )
    return event_logs(spark, sf_dir, costly=True).withColumn("stamp", stamp)


@query("normalize_timestamps", f"WITH {EVENT_LOGS} {_STAMPS}")
def normalize_timestamps(spark, sf_dir):
    rows = stamped(spark, sf_dir).withColumn("normalized", T.normalize_timestamp(F.col("stamp")))
    return rows.select(
        "log_id", "stamp", "normalized", F.unix_micros(T.event_time(F.col("normalized"))).alias("ts_us")
    )


@query(
    "otel_times",
    f"""WITH {EVENT_LOGS}
SELECT log_id, CASE WHEN event_type = 'signup' THEN 'MISSING' ELSE
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) // 1000 % 1000 = 0 THEN '' ELSE strftime(ts, '.%g') || '000' END || 'Z' END AS iso
FROM logs""",
)
def otel_times(spark, sf_dir):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    nanos = F.when(F.col("event_type") == "signup", "later").otherwise((millis * 1_000_000).cast("string"))
    return event_logs(spark, sf_dir, costly=True).select("log_id", T.nanos_text(nanos, F.lit("MISSING")).alias("iso"))


_ODD_LEVEL = (
    "CASE event_type WHEN 'error' THEN 'Warning' WHEN 'purchase' THEN ' fatal ' WHEN 'view' THEN 'trace'"
    " WHEN 'click' THEN 'critical' END"
)


@query(
    "normalize_levels",
    f"""WITH {EVENT_LOGS}
SELECT log_id,
  CASE event_type WHEN 'error' THEN 'WARN' WHEN 'click' THEN 'CRITICAL' ELSE 'INFO' END AS line_level,
  CASE event_type WHEN 'error' THEN 'WARN' WHEN 'purchase' THEN 'FATAL' WHEN 'view' THEN 'TRACE'
                  WHEN 'click' THEN 'CRITICAL' ELSE 'INFO' END AS record_level,
  coalesce(upper(trim({_ODD_LEVEL})), CASE WHEN n BETWEEN 1 AND 4 THEN 'TRACE' WHEN n BETWEEN 5 AND 8 THEN 'DEBUG'
    WHEN n BETWEEN 13 AND 16 THEN 'WARN' WHEN n BETWEEN 17 AND 20 THEN 'ERROR' WHEN n BETWEEN 21 AND 24 THEN 'FATAL'
    ELSE 'INFO' END) AS otel_level
FROM (SELECT *, user_id % 30 AS n FROM logs)""",
)
def normalize_levels(spark, sf_dir):
    odd = F.expr(_ODD_LEVEL)
    return event_logs(spark, sf_dir, costly=True).select(
        "log_id",
        L.line_level(odd).alias("line_level"),
        L.record_level(odd).alias("record_level"),
        L.otel_level(odd, F.col("user_id") % 30).alias("otel_level"),
    )


@query(
    "resolve_service_id",
    f"""WITH {EVENT_LOGS}
SELECT log_id, CASE event_type WHEN 'error' THEN service_id WHEN 'purchase' THEN 'top-' || service_id
  WHEN 'view' THEN 'ns.' || service_id WHEN 'click' THEN 'unknown_service' ELSE 'request' END AS service_id,
  CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'purchase' THEN 'top-' || service_id END AS top_only
FROM logs""",
)
def resolve_service_id(spark, sf_dir):
    kind, service = F.col("event_type"), F.col("service_id")
    top = F.when(kind == "purchase", F.concat(F.lit(" top-"), service, F.lit(" "))).when(kind == "error", "bad service")
    inner = F.create_map(
        F.lit("service"), F.when(kind == "error", service).otherwise(F.lit("../etc")),
        F.lit("service.namespace"), F.when(kind == "view", F.concat(F.lit("ns."), service)),
    )
    outer = F.create_map(F.lit("serviceId"), F.when(kind == "signup", "request"))
    return event_logs(spark, sf_dir, costly=True).select(
        "log_id",
        S.resolve_service_id({"service_id": top}, inner, outer).alias("service_id"),
        S.valid_service_id(top).alias("top_only"),
    )


@query(
    "indexed_service_name",
    f"""WITH {EVENT_LOGS}
SELECT log_id, CASE event_type WHEN 'error' THEN service_id WHEN 'purchase' THEN 'otel-' || service_id
  ELSE 'unknown_service' END AS service_name FROM logs""",
)
def indexed_service_name(spark, sf_dir):
    kind, service = F.col("event_type"), F.col("service_id")
    own = F.when(kind == "error", F.concat(F.lit("  "), service)).otherwise(F.lit("  "))
    metadata = F.create_map(
        F.lit("service.name"), F.when(kind == "purchase", F.concat(F.lit("otel-"), service)), F.lit("service_id"), F.lit(" ")
    )
    return event_logs(spark, sf_dir, costly=True).select("log_id", S.indexed_service_name(own, metadata).alias("service_name"))


def _masked_sql(text: str) -> str:
    for _trigger, pattern, token in M.MASKS:
        text = f"regexp_replace({text}, {_quote(pattern)}, '{token}', 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'), e' \\t\\n\\r')"


@query(
    "normalized_text",
    f"SELECT doc_id, md5({_masked_sql('text')}) AS text_md5 FROM documents",
)
def normalized_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.md5(M.normalized_text(F.col("text"))).alias("text_md5")
    )


@query(
    "normalized_json_text",
    f"""WITH {EVENT_LOGS}
SELECT log_id, CASE event_type WHEN 'error' THEN {_masked_sql('message')} WHEN 'view' THEN '{{"k":<number>}}'
  ELSE {_masked_sql("'see ' || message")} END AS text FROM logs""",
)
def normalized_json_text(spark, sf_dir):
    kind, message = F.col("event_type"), F.col("message")
    body = (
        F.when(kind == "error", F.to_json(F.struct(message.alias("msg"), F.lit("").alias("message"))))
        .when(kind == "view", F.col("props"))
        .otherwise(F.concat(F.lit(" see "), message))
    )
    return event_logs(spark, sf_dir, costly=True).select("log_id", M.normalized_text(body).alias("text"))


@query(
    "semantic_text",
    f"""WITH {EVENT_LOGS}
SELECT log_id, {_masked_sql("'level=' || level || ' service=' || service_id || ' ' || message || ' ' || '{\"region\":\"eu-1\",\"user\":\"' || user_id || '\"}'")} AS text FROM logs""",
)
def semantic_text(spark, sf_dir):
    metadata = F.to_json(F.create_map(F.lit("region"), F.lit("eu-1"), F.lit("user"), F.col("user_id").cast("string")))
    return event_logs(spark, sf_dir, costly=True).select(
        "log_id", M.semantic_text(F.col("message"), F.col("level"), F.col("service_id"), metadata).alias("text")
    )


_SEVERITY = """CASE WHEN contains(lower({t}), 'critical') OR contains(lower({t}), 'fatal') THEN 'critical'
 WHEN contains(lower({t}), 'error') OR contains(lower({t}), 'exception') OR contains(lower({t}), 'failure') THEN 'error'
 WHEN contains(lower({t}), 'warn') OR contains(lower({t}), 'rate limit') THEN 'warn' ELSE 'info' END"""


@query(
    "infer_severity",
    f"SELECT page_id, {_SEVERITY.replace('{t}', 'html')} AS html_severity, {_SEVERITY.replace('{t}', 'url')} AS url_severity FROM pages",
)
def infer_severity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        L.inferred_severity(F.col("html")).alias("html_severity"),
        L.inferred_severity(F.col("url")).alias("url_severity"),
    )


@query(
    "service_word",
    f"""WITH {EVENT_LOGS}
SELECT log_id, CASE event_type WHEN 'error' THEN service_id || '-Service' WHEN 'view' THEN 'services' END AS word FROM logs""",
)
def service_word(spark, sf_dir):
    kind, service = F.col("event_type"), F.col("service_id")
    message = (
        F.when(kind == "error", F.concat(F.lit("first-service then ("), service, F.lit("-Service), failed")))
        .when(kind == "view", "all [services]")
        .otherwise(F.col("message"))
    )
    return event_logs(spark, sf_dir, costly=True).select("log_id", S.service_word(message).alias("word"))


@query(
    "vector_normalize",
    """SELECT vec_id, round(embedding[1] / n, 6) AS first_value, round(embedding[64] / n, 6) AS last_value
FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)""",
)
def vector_normalize(spark, sf_dir):
    unit = V.unit_vector(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("unit")).select(
        "vec_id", F.round(F.col("unit")[0], 6).alias("first_value"), F.round(F.col("unit")[63], 6).alias("last_value")
    )


@query(
    "cosine_neighbours",
    """SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_neighbours(spark, sf_dir):
    left = table(spark, sf_dir, "embeddings")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return left.join(right, "vec_id").select(
        "vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("score")
    )


@query(
    "escaped_markup",
    "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages",
)
def escaped_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(escape_markup(F.col("html"))).alias("escaped_md5"))


@query(
    "explanation_fields",
    """SELECT doc_id, 'Detected issue in logs: ' || substr(text, 1, 120) AS problem_summary,
 'Backend ingestion pipeline / API / service layer' AS affected_component FROM documents""",
)
def explanation(spark, sf_dir):
    fields = document_logs(spark, sf_dir).select(
        F.col("log_id").alias("doc_id"), explanation_fields(F.col("message")).alias("fields")
    )
    return fields.select(
        "doc_id",
        F.col("fields").getField("Problem Summary").alias("problem_summary"),
        F.col("fields").getField("Affected Component").alias("affected_component"),
    )
