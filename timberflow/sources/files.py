"""Collected log files: JSON lines and syslog, batch or stream.

The readers return ``value`` and ``path``; the parsers work on any DataFrame
with a ``value`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timberflow.functions.text import filled, non_empty
from timberflow.operators.pinning import pin

# The syslog line form and the severity words, in order of
# precedence, with the severity each stands for.
SYSLOG_LINE = (
    r"(?Ud)^(\w{3}\s+\d{1,2}\s+\S+)\s+(\S+)\s+(?:([^\s:]+?)(?:\[(\d+)\])?:\s*)?(.*)$"
)
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
LEVEL_NAMES = ("trace", "debug", "info", "warn", "error", "fatal")
SEVERITY_WORDS = (("error", "error"), ("fail", "error"), ("warn", "warn"), ("warning", "warn"), ("info", "info"))
HOST_SERVICE = "host-syslog"


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    streaming: bool = False,
    pattern: str | None = None,
    exclude: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Lines of the files under ``path``. ``pattern`` is a file name glob;
    ``exclude`` a SQL LIKE pattern over full paths to leave out."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.format("text").load(path).select("value", F.col("_metadata.file_path").alias("path"))
    return lines.filter(~F.col("path").like(exclude)) if exclude else lines


def json_lines(df: DataFrame) -> DataFrame:
    """Per-line JSON: time, severity by level name, message as body, all keys
    as ``attributes``. A line that is not a JSON object is kept as body."""
    attributes = F.from_json("value", "map<string,string>")
    level = F.lower(F.try_element_at("attributes", F.lit("level")))
    return pin(df, {"attributes": F.when(F.try_parse_json("value").isNotNull(), attributes)}).withColumns(
        {
            "ts": F.try_to_timestamp(F.try_element_at("attributes", F.lit("timestamp")), F.lit(JSON_TIME)),
            "severity": F.when(level.isin(*LEVEL_NAMES), level),
            "body": F.coalesce(F.try_element_at("attributes", F.lit("message")), F.col("value")),
        }
    )


def syslog_lines(df: DataFrame, year: Column | int) -> DataFrame:
    """Syslog lines. They carry no year, so ``year`` says which. Severity comes
    from words in the line. Fields are null where the form does not fit."""
    year = F.lit(year) if isinstance(year, int) else year
    fits = F.col("value").rlike(SYSLOG_LINE)

    def group(index: int) -> Column:
        return F.when(fits, non_empty(F.regexp_extract("value", SYSLOG_LINE, index)))

    stamp = F.concat_ws(" ", year.cast("string"), F.regexp_replace(group(1), r"\s+", " "))
    severity = F.lit(None).cast("string")
    for word, name in reversed(SEVERITY_WORDS):
        severity = F.when(F.contains(F.lower("value"), F.lit(word)), name).otherwise(severity)
    named = F.map_filter(
        F.create_map(
            F.lit("hostname"), group(2), F.lit("service"), group(3), F.lit("pid"), group(4)
        ),
        lambda _key, value: value.isNotNull(),
    )
    return df.withColumns(
        {
            "ts": F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss")),
            "attributes": named,
            "severity": severity,
            "body": F.when(fits, F.regexp_extract("value", SYSLOG_LINE, 5)).otherwise(F.col("value")),
        }
    )


def service_name(attributes: Column, resource: Column | None = None) -> Column:
    """``service.name`` of a collected record: the service_id attribute, else
    the resource's own name, else the service attribute, else host-syslog."""
    return F.coalesce(
        F.try_element_at(attributes, F.lit("service_id")),
        *([filled(resource)] if resource is not None else []),
        F.try_element_at(attributes, F.lit("service")),
        F.lit(HOST_SERVICE),
    )


def collected_records(df: DataFrame) -> DataFrame:
    """Parsed file lines as JSON records for ``structured_records``."""
    record = F.struct(
        F.date_format("ts", JSON_TIME).alias("timestamp"),
        F.col("severity").alias("level"),
        service_name(F.col("attributes")).alias("service_id"),
        F.try_element_at("attributes", F.lit("hostname")).alias("host"),
        F.col("body").alias("message"),
        F.coalesce(
            F.map_filter("attributes", lambda key, _v: ~key.isin("timestamp", "level", "message")),
            F.create_map().cast("map<string,string>"),
        ).alias("metadata"),
    )
    return df.withColumn("value", F.to_json(record))
