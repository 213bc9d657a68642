"""Timestamp normalisation as column expressions (session zone: UTC).

Epoch seconds or milliseconds, ISO-8601 with or without offset and a few
looser layouts become one ISO-8601 text. An offset is kept, a naive time stays
naive, and what cannot be read is returned unchanged. An infinite epoch value
is treated as unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from timberflow.functions.text import let, strip

_FLOAT = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"
_OFFSET = r"[+-]\d{2}:\d{2}(?::\d{2}(?:\.\d{6})?)?$"
_ISO = (
    r"(?s)^(?!0000)\d{4}-\d{2}-\d{2}"
    r"(?:.(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:\.(?:\d{3}|\d{6}))?)?)?"
    r"(?:[+-](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{6})?)?)?)?$"
)
# Date and time with one-digit fields allowed; the fraction needs a blank
# separator without Z or a T separator with Z.
_LOOSE = (
    r"^(?!0000)(\d{4})-(\d{1,2})-( ?\d{1,2})"
    r"(?:\s+(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6}))?"
    r"|T(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6})(?=Z))?Z?)$"
)

_EARLIEST = -62135596800.0
_LATEST = 253402300800.0


def _micros_text(micros: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss[.ffffff]`` of microseconds since the epoch."""
    stamp = F.timestamp_micros(micros)
    return F.when(
        F.pmod(micros, F.lit(1_000_000)) == 0,
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"),
    ).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def epoch_text(stripped: Column) -> Column:
    """ISO text of an epoch literal; values above 1e10 are milliseconds."""

    def of_seconds(seconds: Column) -> Column:
        whole = F.when(seconds < 0, F.ceil(seconds)).otherwise(F.floor(seconds))
        micros = whole * 1_000_000 + F.rint((seconds - whole) * 1e6).cast("bigint")
        return F.when(
            (seconds >= _EARLIEST) & (seconds < _LATEST),
            F.concat(let(micros, _micros_text), F.lit("+00:00")),
        )

    def of_number(number: Column) -> Column:
        return let(F.when(number > 1e10, number / 1000).otherwise(number), of_seconds)

    number = F.replace(stripped, F.lit("_")).try_cast("double")
    return F.when(stripped.rlike(_FLOAT), let(number, of_number))


def iso_text(stripped: Column) -> Column:
    """ISO text of a strict ISO date or date-time; null when it is not one."""

    def assembled(zoned: Column, offset: Column, clock: Column) -> Column:
        # Short clocks ("10" or "10:30") are completed from the fixed tail.
        filled_clock = F.concat(
            F.substring(clock, 1, 8),
            F.substring(F.lit("00:00:00"), F.least(F.length(clock), F.lit(8)) + 1, F.lit(8)),
        )
        micros = F.rpad(F.substring(clock, 10, 6), 6, F.lit("0"))
        printed_fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
        # "+05:30:00" prints as "+05:30", and a negative zero offset as "+00:00".
        short_offset = F.regexp_replace(offset, r"^([+-]\d{2}:\d{2})(?::00(?:\.0+)?)?$", "$1")
        printed_offset = F.when(short_offset == "-00:00", "+00:00").otherwise(short_offset)
        return F.concat(F.substring(zoned, 1, 10), F.lit("T"), filled_clock, printed_fraction, printed_offset)

    def of_zoned(zoned: Column) -> Column:
        offset = F.regexp_extract(F.substring(zoned, 14, 40), _OFFSET, 0)
        real_day = F.substring(zoned, 1, 10).try_cast("date").isNotNull()
        text = let(
            offset,
            lambda o: let(
                F.substring(zoned, F.lit(12), F.length(zoned) - 11 - F.length(o)),
                lambda clock: assembled(zoned, o, clock),
            ),
        )
        return F.when(zoned.rlike(_ISO) & real_day, text)

    zoned = F.when(
        stripped.endswith("Z"), F.concat(F.substring(stripped, F.lit(1), F.length(stripped) - 1), F.lit("+00:00"))
    ).otherwise(stripped)
    return let(zoned, of_zoned)


def loose_text(stripped: Column) -> Column:
    """ISO text of the looser layouts, always naive; null when none fits."""

    def of_fields(fields: Column) -> Column:
        number = lambda index: F.btrim(fields[index]).try_cast("int")
        stamp = F.try_make_timestamp_ntz(
            number(0),
            number(1),
            number(2),
            number(3),
            number(4),
            F.when(number(5) < 60, number(5)).cast("decimal(8,6)"),
        )
        micros = F.rpad(fields[6], 6, F.lit("0"))
        return F.concat(
            F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        )

    # Either clock alternative fills its groups and leaves the other's empty.
    fields = F.split(F.regexp_replace(stripped, _LOOSE, r"$1|$2|$3|$4$8|$5$9|$6$10|$7$11"), r"\|", -1)
    return F.when(stripped.rlike(_LOOSE), let(fields, of_fields))


def normalize_timestamp(column: Column) -> Column:
    """The canonical text of a timestamp text; unreadable input unchanged."""
    return let(
        strip(column),
        lambda s: F.when(s != "", F.coalesce(epoch_text(s), iso_text(s), loose_text(s), column)),
    )


def event_time(normalized: Column) -> Column:
    """Typed companion of :func:`normalize_timestamp`; null if unreadable."""
    return F.when(
        normalized.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), normalized.try_cast("timestamp")
    )


def nanos_text(nanos: Column, missing: Column) -> Column:
    """ISO text ending in Z of nanoseconds since the epoch; ``missing`` (the
    caller's ingest time, as text) stands in for absent or invalid input.

    The nanoseconds pass through a double, as the values to match do, so the
    last microsecond digits carry that rounding.
    """
    seconds = nanos.try_cast("double") / 1e9
    whole = F.floor(seconds)
    micros = whole * 1_000_000 + F.rint((seconds - whole) * 1e6).cast("bigint")
    return F.coalesce(
        F.when(
            (seconds != 0) & (seconds >= _EARLIEST) & (seconds < _LATEST),
            F.concat(_micros_text(micros), F.lit("Z")),
        ),
        missing,
    )
