"""Service identity: validation and resolution order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from timberflow.functions.text import filled, strip

# Accepted shape of an id and the keys that may carry one.
SERVICE_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}\z"
SERVICE_KEYS = ("service_id", "serviceId", "service", "service.name", "service.namespace")
UNKNOWN_SERVICE = "unknown_service"
_EDGE_MARKS = ".,:;\"'()[]{}"


def valid_service_id(column: Column) -> Column:
    """The stripped id when it is well-formed, else null."""
    stripped = strip(column)
    return F.when(stripped.rlike(SERVICE_ID_PATTERN), stripped)


def resolve_service_id(
    top: dict[str, Column] | None = None,
    *maps: Column,
    default: str | None = UNKNOWN_SERVICE,
) -> Column:
    """First valid id: named top-level columns first, then each
    ``map<string,string>`` column in turn; inside each, ``SERVICE_KEYS`` order."""
    top = top or {}
    candidates = [valid_service_id(top[key]) for key in SERVICE_KEYS if key in top]
    for source in maps:
        candidates += [valid_service_id(F.try_element_at(source, F.lit(key))) for key in SERVICE_KEYS]
    if default is not None:
        candidates.append(F.lit(default))
    return F.coalesce(*candidates) if candidates else F.lit(None).cast("string")


def indexed_service_name(service: Column, metadata: Column) -> Column:
    """The name stored with an indexed log: first non-blank of the record's
    service and the metadata's service, service.name and service_id."""
    return F.coalesce(
        filled(service),
        *[filled(F.try_element_at(metadata, F.lit(key))) for key in ("service", "service.name", "service_id")],
        F.lit(UNKNOWN_SERVICE),
    )


def service_word(message: Column) -> Column:
    """The last word that mentions "service", without its edge punctuation."""
    word = F.regexp_extract(message, r"(?sUi)^(?:.*\s)?(\S*service\S*)", 1)
    return F.when(
        F.contains(F.lower(message), F.lit("service")), F.btrim(word, F.lit(_EDGE_MARKS))
    )
