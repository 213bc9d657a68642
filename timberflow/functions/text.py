"""Small text helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's ``str.strip()`` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(column: Column) -> Column:
    """Trim every Unicode white space character (``trim`` only takes blanks)."""
    return F.btrim(column, F.lit(WHITESPACE))


def filled(column: Column) -> Column:
    """The stripped text, or null when nothing is left of it."""
    stripped = strip(column)
    return F.when(stripped != "", stripped)


def is_blank(column: Column) -> Column:
    return F.coalesce(strip(column) == "", F.lit(True))


def non_empty(column: Column) -> Column:
    return F.when(column != "", column)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body
    mentions it. Keeps chains of rules linear in size."""
    return F.element_at(F.transform(F.array(value), lambda bound: body(bound)), 1)


def rewrite_matches(text: Column, pattern: str, rewrite) -> Column:
    """Replace each match of ``pattern`` by ``rewrite(match)``.

    ``regexp_replace`` takes a fixed replacement, so the text is cut at the
    matches and stitched together again. Texts without a match skip all that.
    """
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    stitched = F.array_join(
        F.zip_with(
            pieces,
            matches,
            lambda piece, match: F.when(match.isNull(), piece).otherwise(F.concat(piece, rewrite(match))),
        ),
        "",
    )
    return F.when(text.rlike(pattern), stitched).otherwise(text)


def escape_markup(column: Column) -> Column:
    """Escape ``& < >`` for display; the ampersand has to come first."""
    escaped = F.replace(column, F.lit("&"), F.lit("&amp;"))
    escaped = F.replace(escaped, F.lit("<"), F.lit("&lt;"))
    return F.replace(escaped, F.lit(">"), F.lit("&gt;"))
