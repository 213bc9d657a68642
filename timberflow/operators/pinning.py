"""Compute costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but evaluated exactly once.

    The optimizer moves a filter below a projection by repeating the
    projection's expressions inside the filter; with expressions that build on
    each other this multiplies regular expression work. A generator is where
    such moves stop, so the columns go through a one-element ``inline``.
    Filters on other columns still pass below it, to the scan.
    """
    kept = [name for name in df.columns if name not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline_outer(F.array(row)))
