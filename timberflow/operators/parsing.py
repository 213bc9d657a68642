"""Line parsing: the strict two-format parser and the multi-format parser."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from timberflow.functions.levels import line_level
from timberflow.functions.services import service_word
from timberflow.functions.text import is_blank, non_empty, strip
from timberflow.functions.timestamps import normalize_timestamp
from timberflow.operators.pinning import pin

# The bracketed line form. FATAL and TRACE lines do not match.
STANDARD_LINE = r"(?id)^\[(.*?)\]\s+(INFO|WARN|WARNING|ERROR|DEBUG|CRITICAL):\s+(.*)$"
BRACED_LINE = r"(?d)^\{.*\}$"
_RESERVED = ("timestamp", "level", "message")


def _with_service(metadata: Column, message: Column, of_variants: bool = False) -> Column:
    """The service word found in the message overrides an explicit service."""
    word = service_word(message)
    if of_variants:
        word = word.cast("variant")
    return F.when(
        word.isNotNull(), F.map_concat(metadata, F.create_map(F.lit("service"), word))
    ).otherwise(metadata)


def _json_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _unusable(value: Column) -> Column:
    """A timestamp or level that is neither text nor empty-like breaks the
    structured branch, and the line is then taken as plain braces."""
    text = value.try_cast("string")
    empty_like = F.coalesce(text.isin("0", "0.0", "-0.0", "false", "[]", "{}"), F.lit(True))
    return F.coalesce((_json_type(value) != "STRING") & ~empty_like, F.lit(False))


def parse_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Strict parse of one log line per row.

    Adds ``timestamp, level, message, metadata_kv, metadata, parser_type,
    raw`` (all null when no form fits) and the flags of
    :func:`parser_metrics`. ``metadata_kv`` is flat text for filters;
    ``metadata`` keeps the nested values of a structured line as VARIANT.
    """
    clean = F.col("__clean")
    body = F.col("__json")
    braces = clean.startswith("{") & clean.endswith("}")
    staged = pin(df, {"__clean": F.when(~is_blank(F.col(column)), strip(F.col(column)))})
    staged = pin(staged, {"__json": F.when(braces, F.try_parse_json("__clean"))})
    usable_json = F.coalesce(
        _json_type(body).startswith("OBJECT")
        & ~_unusable(F.try_variant_get(body, "$.timestamp", "variant"))
        & ~_unusable(F.try_variant_get(body, "$.level", "variant")),
        F.lit(False),
    )
    staged = pin(staged, {"__structured": usable_json})
    staged = pin(
        staged,
        {
            "parser_type": F.when(F.col("__structured"), "structured_json")
            .when(clean.rlike(STANDARD_LINE), "standard")
            .when(clean.rlike(BRACED_LINE), "fallback_json")
        },
    )
    kind = F.col("parser_type")
    structured, standard, braced = kind == "structured_json", kind == "standard", kind == "fallback_json"

    # One JSON read gives the flat map; reserved keys are dropped from it.
    extras = F.map_filter(
        F.from_json(clean, "map<string,string>"), lambda key, _value: ~key.isin(*_RESERVED)
    )
    nested = F.map_filter(
        F.from_json(clean, "map<string,variant>"), lambda key, _value: ~key.isin(*_RESERVED)
    )
    no_metadata = F.create_map().cast("map<string,string>")
    stamp_text = F.try_variant_get(body, "$.timestamp", "string")

    is_text = _json_type(F.try_variant_get(body, "$.timestamp", "variant")) == "STRING"
    parsed = pin(
        staged,
        {
            "__stamp": F.when(structured, F.when(is_text, stamp_text))
            .when(standard, F.regexp_extract(clean, STANDARD_LINE, 1))
            .when(braced, F.lit("")),
            "level": F.when(structured, line_level(F.try_variant_get(body, "$.level", "string")))
            .when(standard, line_level(F.regexp_extract(clean, STANDARD_LINE, 2)))
            .when(braced, F.lit("INFO")),
            "message": F.when(structured, F.coalesce(F.try_variant_get(body, "$.message", "string"), F.lit("")))
            .when(standard, F.regexp_extract(clean, STANDARD_LINE, 3))
            .when(braced, clean),
        },
    )
    parsed = pin(parsed, {"timestamp": normalize_timestamp(F.col("__stamp"))})

    matched = F.col("parser_type").isNotNull()
    result = parsed.withColumns(
        {
            "timestamp": F.when(structured, F.col("timestamp")).otherwise(
                F.coalesce(F.col("timestamp"), F.col("__stamp"))
            ),
            "metadata_kv": F.when(structured, _with_service(extras, F.col("message"))).when(
                matched, _with_service(no_metadata, F.col("message"))
            ),
            "metadata": F.when(structured, F.to_variant_object(_with_service(nested, F.col("message"), of_variants=True))).when(
                matched, F.to_variant_object(_with_service(no_metadata, F.col("message")))
            ),
            "raw": F.when(matched, clean),
            "is_empty": clean.isNull(),
            "is_malformed_json": F.coalesce(braces & body.isNull(), F.lit(False)),
            "timestamp_failed": F.coalesce(
                (standard | braced) & (F.col("timestamp") == F.col("__stamp")) & (F.col("__stamp") != ""),
                F.lit(False),
            ),
        }
    )
    return result.drop("__clean", "__json", "__structured", "__stamp")


def parser_metrics(parsed: DataFrame) -> DataFrame:
    """One row of counters over :func:`parse_lines` output.

    An empty line counts as empty and failed; broken JSON in braces counts as
    failed and again as parsed.
    """
    kind = F.col("parser_type")
    return parsed.agg(
        F.count_if(kind.isNotNull()).alias("parsed_logs"),
        F.sum(
            F.col("is_malformed_json").cast("bigint") + kind.isNull().cast("bigint")
        ).alias("failed_logs"),
        F.count_if(kind == "structured_json").alias("structured_json_logs"),
        F.count_if(kind.isin("standard", "fallback_json")).alias("standard_logs"),
        F.count_if("timestamp_failed").alias("timestamp_failures"),
        F.count_if("is_empty").alias("empty_logs"),
    )


@dataclass(frozen=True)
class Format:
    """A line format. ``groups`` names the capture groups in order; the flags
    say whether timestamp, level and message are taken from their group.
    ``needs`` are literals every match contains."""

    name: str
    pattern: str
    groups: tuple[str, ...] = ()
    priority: int = 1
    use_timestamp: bool = False
    use_level: bool = False
    use_message: bool = False
    needs: tuple[str, ...] = field(default=())

    @property
    def regex(self) -> str:
        return "(?Ud)" + self.pattern

    def hits(self, line: Column) -> Column:
        found = line.rlike(self.regex)
        for literal in reversed(self.needs):
            found = F.contains(line, F.lit(literal)) & found
        return found

    def capture(self, line: Column, name: str) -> Column:
        return F.regexp_extract(line, self.regex, self.groups.index(name) + 1)


# Names, patterns, captured fields and priorities.
BUILTIN_FORMATS = (
    Format(
        "apache_combined",
        r'(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+(\S+)"\s+(\d+)\s+(\d+|-)\s+"([^"]*)" "([^"]*)"',
        ("ip", "ident", "user", "timestamp", "method", "path", "protocol", "status", "size", "referer", "useragent"),
        10,
        needs=('" "',),
    ),
    Format(
        "syslog",
        r"(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+)(?:\[(\d+)\])?:\s+(.*)",
        ("timestamp", "hostname", "process", "pid", "message"),
        9,
        needs=(":",),
    ),
    Format(
        "iso8601_structured",
        r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\s]*)\s+\[(\w+)\]\s+(\S+)\s+(.*)",
        ("timestamp", "level", "source", "message"),
        8,
        use_level=True,
        use_message=True,
        needs=("[", ":"),
    ),
    Format("json", r"^\{.*\}$", (), 7),
    Format(
        "kubernetes",
        r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.\d+Z)\s+(\w+)\s+(\S+)\s+(\S+)/(\S+)\s+(.*)",
        ("timestamp", "level", "source", "namespace", "pod", "message"),
        6,
        use_level=True,
        needs=("/", ":"),
    ),
    Format(
        "docker",
        r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.\d+Z)\s+\[(\w+)\]\s+(\S+):\s+(.*)",
        ("timestamp", "level", "module", "message"),
        5,
        use_level=True,
        needs=("[", ":"),
    ),
    Format(
        "generic_timestamp_level",
        r"(\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+\[(\w+)\]\s+(.*)",
        ("timestamp", "level", "message"),
        4,
        use_level=True,
        use_message=True,
        needs=("[", ":"),
    ),
    Format("key_value", r"(.*?)(?:\s+\w+=[^\s]+)*$", ("message",), 2, use_message=True),
    Format("plain_text", r"(.+)", ("message",), 1, use_message=True),
)


def custom_format(
    name: str,
    pattern: str,
    groups: tuple[str, ...] = (),
    use_timestamp: bool = False,
    use_level: bool = False,
    use_message: bool = False,
) -> Format:
    """A user format; it is tried before every built-in one."""
    return Format(name, pattern, tuple(groups), 100, use_timestamp, use_level, use_message)


def _ordered(custom: tuple[Format, ...]) -> list[Format]:
    latest = {fmt.name: fmt for fmt in custom}
    return sorted([*latest.values(), *BUILTIN_FORMATS], key=lambda fmt: -fmt.priority)


def _filled_quarters(fmt: Format, line: Column) -> tuple[Column, list[int]]:
    """Filled fields out of four (timestamp, level, message, metadata) of a
    match, and the values this can take."""
    fixed = 0
    variable = []

    def captured(flag: bool, name: str) -> None:
        nonlocal fixed
        if flag and name in fmt.groups:
            variable.append((fmt.capture(line, name) != "").cast("int"))
        elif name != "timestamp":
            fixed += 1

    captured(fmt.use_timestamp, "timestamp")
    captured(fmt.use_level, "level")
    captured(fmt.use_message, "message")
    fixed += any(name not in _RESERVED for name in fmt.groups)
    total = F.lit(fixed)
    for part in variable:
        total = total + part
    return total, list(range(fixed, fixed + len(variable) + 1))


def parse_multi_format(
    df: DataFrame, column: str = "value", custom: tuple[Format, ...] = ()
) -> DataFrame:
    """Best format per line by coverage, then priority.

    JSON objects come first with coverage 1.0. Otherwise the winner is the
    format with the most filled fields, the higher priority on a tie. The
    choice is one CASE over (coverage, priority) steps from the best down, so
    a line stops at its winner and later expressions are never run for it.
    Adds ``success, parser_used, coverage, timestamp, level, message,
    metadata_kv, captured_timestamp, is_json, error_message``.
    """
    line = F.col(column)
    trimmed = strip(line)
    blank = is_blank(line)
    body = F.col("__json")
    formats = _ordered(custom)
    staged = pin(
        df, {"__json": F.when(trimmed.startswith("{") & trimmed.endswith("}"), F.try_parse_json(trimmed))}
    )
    staged = pin(
        staged,
        {"is_json": F.coalesce(
            _json_type(body).startswith("OBJECT")
            # Absent: the default INFO. Present but not text: not usable.
            & F.coalesce(
                _json_type(F.try_variant_get(body, "$.level", "variant")) == "STRING", F.lit(True)
            ),
            F.lit(False),
        )},
    )
    steps = []
    for rank, fmt in enumerate(formats):
        quarters, possible = _filled_quarters(fmt, line)
        steps += [(-value, rank, fmt, quarters, len(possible) > 1) for value in possible if value]
    winner = F.when(blank | F.col("is_json"), F.lit(None).cast("int"))
    for value, rank, fmt, quarters, varies in sorted(steps, key=lambda step: step[:2]):
        condition = fmt.hits(line) & (quarters == -value) if varies else fmt.hits(line)
        winner = winner.when(condition, F.lit(rank * 10 - value))
    ranked = pin(staged, {"__winner": winner})
    ranked = pin(ranked, {"__rank": F.floor(F.col("__winner") / 10).cast("int")})

    def per_format(make) -> Column:
        choice = None
        for rank, fmt in enumerate(formats):
            value = make(fmt)
            if value is None:
                continue
            hit = F.col("__rank") == rank
            choice = F.when(hit, value) if choice is None else choice.when(hit, value)
        return F.lit(None).cast("string") if choice is None else choice

    def metadata(fmt: Format):
        names = [name for name in fmt.groups if name not in _RESERVED]
        if not names:
            return None
        pairs = [part for name in names for part in (F.lit(name), non_empty(fmt.capture(line, name)))]
        return F.create_map(*pairs)

    is_json = F.col("is_json")
    matched = F.col("__rank").isNotNull()
    json_extras = F.map_filter(
        F.from_json(trimmed, "map<string,string>"), lambda key, _value: ~key.isin(*_RESERVED)
    )
    return ranked.withColumns(
        {
            "success": is_json | matched,
            "parser_used": F.when(is_json, F.lit("json"))
            .when(matched, per_format(lambda fmt: F.lit(fmt.name)))
            .when(~blank, F.lit("fallback")),
            "coverage": F.when(is_json, F.lit(1.0)).otherwise(
                F.coalesce(F.pmod(F.col("__winner"), F.lit(10)) / 4.0, F.lit(0.0))
            ),
            "timestamp": F.when(is_json, F.try_variant_get(body, "$.timestamp", "string")).otherwise(
                per_format(lambda fmt: fmt.capture(line, "timestamp") if fmt.use_timestamp and "timestamp" in fmt.groups else None)
            ),
            "level": F.when(is_json, F.upper(F.coalesce(F.try_variant_get(body, "$.level", "string"), F.lit("INFO")))).when(
                matched,
                F.coalesce(
                    per_format(lambda fmt: F.upper(fmt.capture(line, "level")) if fmt.use_level and "level" in fmt.groups else None),
                    F.lit("INFO"),
                ),
            ),
            "message": F.when(is_json, F.coalesce(F.try_variant_get(body, "$.message", "string"), F.lit(""))).when(
                matched,
                F.coalesce(
                    per_format(lambda fmt: fmt.capture(line, "message") if fmt.use_message and "message" in fmt.groups else None),
                    line,
                ),
            ),
            "metadata_kv": F.when(is_json, json_extras).when(
                matched, F.coalesce(per_format(metadata).cast("map<string,string>"), F.create_map().cast("map<string,string>"))
            ),
            "captured_timestamp": F.when(
                matched, per_format(lambda fmt: fmt.capture(line, "timestamp") if "timestamp" in fmt.groups else None)
            ),
            "error_message": F.when(blank, F.lit("Empty log line")).when(
                ~is_json & ~matched, F.lit("No matching parser found")
            ),
        }
    ).drop("__json", "__winner", "__rank")


def parse_statistics(parsed: DataFrame, column: str = "value") -> DataFrame:
    """One row of totals over :func:`parse_multi_format` output."""
    attempted = ~is_blank(F.col(column))
    complete = attempted & (F.col("coverage") == 1.0)
    partial = attempted & (F.col("coverage") >= 0.5) & ~(F.col("coverage") == 1.0)
    return parsed.agg(
        F.count_if(attempted).alias("total_attempted"),
        F.count_if(complete).alias("successfully_parsed"),
        F.count_if(partial).alias("partially_parsed"),
        F.count_if(attempted & (F.col("coverage") < 0.5)).alias("failed"),
        F.coalesce(F.try_divide(F.count_if(complete), F.count_if(attempted)), F.lit(0.0)).alias("success_rate"),
    )


def format_coverage(parsed: DataFrame, column: str = "value", custom: tuple[Format, ...] = ()) -> DataFrame:
    """Per format: how many lines it matched while it was being tried. JSON
    lines are never tried, and trying stops at full coverage."""
    line = F.col(column)
    tried = ~is_blank(line) & ~F.col("is_json")
    counts = []
    for fmt in _ordered(custom):
        hit = fmt.hits(line)
        counts.append((fmt, F.count_if(tried & hit)))
        quarters, possible = _filled_quarters(fmt, line)
        if possible[-1] == 4:
            tried = tried & ~(hit & (quarters == 4))
    return _unpivot(parsed, counts)


def _unpivot(df: DataFrame, counts: list[tuple[Format, Column]]) -> DataFrame:
    """All counters in one aggregation over the lines, then one row each."""
    row = df.agg(*[count.alias(f"c{index}") for index, (_fmt, count) in enumerate(counts)])
    entries = F.array(
        *[
            F.struct(
                F.lit(fmt.name).alias("name"),
                F.lit(fmt.priority).alias("priority"),
                F.col(f"c{index}").alias("matches"),
                F.lit(index).alias("position"),
            )
            for index, (fmt, _count) in enumerate(counts)
        ]
    )
    return row.select(F.explode(entries).alias("entry")).select("entry.*")


def format_matches(df: DataFrame, column: str = "value") -> DataFrame:
    """Per built-in format: lines it matches, and the number of lines."""
    line = F.col(column)
    counts = [(fmt, F.count_if(fmt.hits(line))) for fmt in BUILTIN_FORMATS]
    lines = df.agg(F.count("*").alias("lines"))
    return _unpivot(df, counts).withColumn("lines", lines.scalar())


def suggest_format(df: DataFrame, column: str = "value") -> DataFrame:
    """The built-in format that fits most of the lines: at least five lines,
    more than 70 % matched, list order on a tie. No row when none qualifies."""
    return (
        format_matches(df, column)
        .filter((F.col("lines") >= 5) & (F.col("matches") > F.col("lines") * 0.7))
        .orderBy(F.desc("matches"), "position")
        .limit(1)
        .select(F.col("name").alias("suggested_pattern"), "matches", "lines")
    )


def batch_report(parsed: DataFrame) -> DataFrame:
    """One row: totals and lines per winning format. Lines are counted per
    format first, so they are parsed once and a handful of rows is summed."""
    lines = parsed.groupBy("parser_used").agg(
        F.count("*").alias("lines"), F.count_if("success").alias("good"), F.count_if(~F.col("success")).alias("bad")
    )
    used = F.when(F.col("parser_used").isNotNull(), F.struct("parser_used", F.col("lines").alias("count")))
    total = {name: F.coalesce(F.sum(name), F.lit(0)) for name in ("lines", "good", "bad")}
    return lines.agg(
        total["lines"].alias("total_lines"),
        total["good"].alias("successfully_parsed"),
        total["bad"].alias("failed_to_parse"),
        F.coalesce(F.try_divide(F.sum("good"), F.sum("lines")), F.lit(0.0)).alias("success_rate"),
        F.map_from_entries(F.array_sort(F.collect_list(used))).alias("parser_usage"),
    )


def parser_usage(parsed: DataFrame) -> DataFrame:
    return parsed.filter("parser_used is not null").groupBy("parser_used").agg(F.count("*").alias("lines"))


def sample_analysis(parsed: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Per line: its first 100 characters and the outcome."""
    return parsed.select(
        *keep, F.substring(column, 1, 100).alias("line"), "success", "parser_used", "coverage"
    )


def parser_health(statistics: DataFrame) -> DataFrame:
    return statistics.select(
        F.when(F.col("success_rate") > 0.8, "healthy").otherwise("degraded").alias("status"),
        "success_rate",
        F.col("total_attempted").alias("total_logs_processed"),
    )


def probe_pattern(df: DataFrame, pattern: str, groups: tuple[str, ...] = (), column: str = "value") -> DataFrame:
    """Try a pattern on each line: does it match, and what do its groups hold."""
    regex = "(?Ud)" + pattern
    line = F.col(column)
    captured = [part for index, name in enumerate(groups) for part in (F.lit(name), F.regexp_extract(line, regex, index + 1))]
    matches = F.coalesce(line.rlike(regex), F.lit(False))
    values = F.create_map(*captured) if captured else F.create_map().cast("map<string,string>")
    return df.withColumns(
        {
            "matches": matches,
            "groups": F.when(matches, values),
            "groups_count": F.when(matches, F.lit(len(groups))),
        }
    )
