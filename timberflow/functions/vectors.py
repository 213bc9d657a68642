"""Vector expressions on ``array<float|double>`` columns, JVM only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from timberflow.functions.text import let


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit_vector(vector: Column) -> Column:
    """Scale to length 1 after dropping null elements; a zero vector stays."""
    values = F.transform(F.filter(vector, lambda x: x.isNotNull()), lambda x: x.cast("double"))

    def scaled(v: Column) -> Column:
        # The length is bound first: inside the transform it would be computed
        # again for every element.
        return let(_norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))

    return F.coalesce(let(values, scaled), F.array().cast("array<double>"))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 for empty, zero or unequal vectors."""
    comparable = (F.size(left) == F.size(right)) & (F.size(left) > 0)
    score = let(
        _norm(left) * _norm(right), lambda scale: F.when(scale > 0, dot(left, right) / scale).otherwise(0.0)
    )
    return F.when(comparable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(F.lit(0.0))
