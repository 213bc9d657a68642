"""The canonical log row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CANONICAL = (
    "log_id string, timestamp string, ts timestamp, level string, service_id string, service string, "
    "host string, environment string, message string, source string, metadata variant, "
    "metadata_kv map<string,string>, parser_type string, raw string, redactions map<string,int>"
)
COLUMNS = tuple(part.split()[0] for part in CANONICAL.replace("map<string,string>", "map").replace("map<string,int>", "map").split(", "))


def canonical(df: DataFrame, *keep: str) -> DataFrame:
    """The canonical columns in order, nulls for those a source lacks; rejects
    and other extras go unless kept by name."""
    types = dict(
        part.split(" ", 1) for part in CANONICAL.split(", ")
    )
    chosen = [
        F.col(name) if name in df.columns else F.lit(None).cast(types[name]).alias(name) for name in COLUMNS
    ]
    return df.select(*keep, *chosen)


def stable_id(*parts: Column) -> Column:
    """A log id that is the same on every run: a hash of what identifies the
    record at its source (file and offset, message id, row id)."""
    return F.sha2(F.concat_ws("\x1f", *[part.cast("string") for part in parts]), 256)
