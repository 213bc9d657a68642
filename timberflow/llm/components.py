"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timberflow.session import stored


def _arcs(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo")


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and the smallest node reachable (``comp``) for every node of a
    link. Nodes may be of any type with an order; nulls are left out, repeated
    links and loops are harmless (a node with a loop alone is not returned).

    Each round points neighbours to the smallest one of a node (first larger,
    then smaller ones), which halves long chains; the links are written to the
    shared folder after each round. Hubs only meet their neighbours by equality
    joins whose large keys the engine may split.
    """
    arcs = _arcs(links.select(F.col(a).alias("a"), F.col(b).alias("b")))
    arcs = stored(arcs.distinct(), "links")
    state = _state(arcs)
    while True:
        both = arcs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
            arcs.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(F.array(*(F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in ("lo", "hi")))).alias("arc")
        )
        arcs = stored(_arcs(small.select("arc.a", "arc.b")).distinct(), "links")
        now = _state(arcs)
        if now == state:
            break
        state = now
    return arcs.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionAll(
        arcs.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct()
    )
