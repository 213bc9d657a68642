"""Skew-safe ordering primitives.

A window partitioned by one hot key runs in one task. These helpers give the
same numbers with work cut along a second, bounded axis (a time slice or a
block of consecutive rows); only pre-aggregated counts are ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from timberflow.session import stored


def running_offsets(counts: DataFrame, key: str, slot: str, size: str, fan: int = 1000) -> DataFrame:
    """``offset`` = rows in earlier slots of the same key.

    ``counts`` has one row per (key, slot). Summing in two levels (slots within
    a group of ``fan`` slots, then the groups) keeps each ordered group small.
    """
    grouped = counts.withColumn("__group", F.floor(F.col(slot) / fan))
    within = grouped.withColumn(
        "__within",
        F.sum(size).over(W.partitionBy(key, "__group").orderBy(slot).rowsBetween(W.unboundedPreceding, -1)),
    )
    groups = (
        grouped.groupBy(key, "__group")
        .agg(F.sum(size).alias("__group_size"))
        .withColumn(
            "__before",
            F.sum("__group_size").over(
                W.partitionBy(key).orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .select(key, "__group", "__before")
    )
    return (
        within.join(groups, [key, "__group"])
        .withColumn("offset", F.coalesce("__within", F.lit(0)) + F.coalesce("__before", F.lit(0)))
        .drop("__group", "__within", "__before")
    )


def trailing_counts(
    events: DataFrame,
    key: str,
    micros: str,
    tie: str,
    window_seconds: int,
    slices_per_window: int = 5,
) -> DataFrame:
    """Per event: ``trailing`` = events of its key in ``(t - window, t]`` up to
    and including itself, and ``seq`` = its 1-based position in the key.

    Order is (micros, tie). Time is cut into ``slices_per_window`` slices per
    window. Everything strictly between the first and the current slice of a
    window comes from slice counts; each event is copied once, to the slice in
    which it expires, so one sort per (key, slice) settles both ends exactly.
    """
    width = window_seconds * 1_000_000 // slices_per_window
    window = width * slices_per_window
    if window != window_seconds * 1_000_000:
        raise ValueError("slices_per_window must divide the window")
    n = slices_per_window
    sliced = events.withColumn("__slice", F.floor(F.col(micros) / width))

    counts = sliced.groupBy(key, "__slice").agg(F.count("*").alias("__size"))
    offsets = running_offsets(counts, key, "__slice", "__size").select(
        key, "__slice", F.col("offset").alias("__offset")
    )
    # Events of the n slices before a slice, added up from copies of counts.
    behind = (
        counts.select(key, "__size", F.explode(F.sequence(F.col("__slice") + 1, F.col("__slice") + n)).alias("__slice"))
        .groupBy(key, "__slice")
        .agg(F.sum("__size").alias("__behind"))
    )
    per_slice = offsets.join(behind, [key, "__slice"], "left")

    # Copy 0 is the event, copy 1 its expiry, `window` later.
    copies = sliced.withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(
        {
            "__slice": F.col("__slice") + F.col("__copy") * n,
            "__at": F.col(micros) + F.col("__copy") * window,
        }
    )
    # An expiry at t ends before an arrival at t: the interval is open there.
    order = (
        W.partitionBy(key, "__slice")
        .orderBy("__at", F.desc("__copy"), tie)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    settled = copies.withColumns(
        {
            "__arrived": F.sum((F.col("__copy") == 0).cast("bigint")).over(order),
            "__expired": F.sum(F.col("__copy").cast("bigint")).over(order),
        }
    ).filter("__copy = 0")
    return (
        settled.join(per_slice, [key, "__slice"])
        .withColumn("trailing", F.coalesce("__behind", F.lit(0)) + F.col("__arrived") - F.col("__expired"))
        .withColumn("seq", F.col("__offset") + F.col("__arrived"))
        .drop("__slice", "__copy", "__at", "__arrived", "__expired", "__offset", "__behind")
    )


def moving_frame(
    numbered: DataFrame, key: str, seq: str, rows: int, aggregates: dict[str, Column], block: int = 4096
) -> DataFrame:
    """Aggregates over each row and the ``rows - 1`` rows before it in its key,
    given dense positions ``seq``.

    Rows are cut into blocks of consecutive positions; the last ``rows - 1`` of
    a block are copied to the next, so no task holds a whole key.
    """
    if rows > block:
        raise ValueError("a block must hold a whole frame")
    home = F.floor((F.col(seq) - 1) / block)
    near_end = F.pmod(F.col(seq) - 1, F.lit(block)) >= block - (rows - 1)
    blocks = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    frame = W.partitionBy(key, "__block").orderBy(seq).rowsBetween(-(rows - 1), 0)
    return (
        numbered.withColumn("__block", F.explode(blocks))
        .withColumns({name: column.over(frame) for name, column in aggregates.items()})
        .filter(F.col("__block") == home)
        .drop("__block")
    )


def ranked_values(df: DataFrame, key: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact ``sorted(values)[int(n * p)]`` per key, for each named fraction.
    Null values do not count; a key without values gives no row.

    One pass collapses the rows to counts per distinct (key, value), which are
    dealt by range of (key, value) and written with the number of their range.
    Sums per (key, range) tell which range holds each position, and only those
    ranges are walked in order. Every fraction uses the same table, a hot key is
    spread over its ranges, and a value however frequent is one row.
    """
    spread = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(key).alias("__key"), F.col(value).alias("__value"))
        .agg(F.count("*").alias("__copies"))
        .repartitionByRange("__key", "__value")
        .withColumn("__range", F.spark_partition_id())
    )
    histogram = stored(spread, "histogram")
    by_key = W.partitionBy("__key")
    sizes = (
        histogram.groupBy("__key", "__range")
        .agg(F.sum("__copies").alias("__size"))
        .withColumns(
            {
                "__before": F.sum("__size").over(by_key.orderBy("__range")) - F.col("__size"),
                "__n": F.sum("__size").over(by_key),
            }
        )
    )
    wanted = [
        F.struct(F.lit(name).alias("name"), (F.floor(F.col("__n") * F.lit(p)) + 1 - F.col("__before")).alias("place"))
        for name, p in fractions.items()
    ]
    # One row per (key, name): the range and the 1-based place in it.
    places = (
        sizes.withColumn("__want", F.explode(F.array(*wanted)))
        .filter("__want.place BETWEEN 1 AND __size")
        .select("__key", "__range", "__want.name", "__want.place")
        .withColumnRenamed("__key", "__of")
        .withColumnRenamed("__range", "__in")
    )
    through = F.sum("__copies").over(W.partitionBy("__key", "__range", "name").orderBy("__value"))
    hit = (
        histogram.join(places, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__in")))
        .withColumn("__through", through)
        .filter("place <= __through AND place > __through - __copies")
    )
    return hit.groupBy(F.col("__key").alias(key)).agg(
        *[F.max(F.when(F.col("name") == name, F.col("__value"))).alias(name) for name in fractions]
    )
