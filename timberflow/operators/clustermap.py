"""Two-dimensional map of clusters: positions, labels, density grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timberflow.functions.text import escape_markup, non_empty

# Map size and grid resolution.
GRID = 80


def label_text(service: Column, count: Column, label: Column, summary: Column, representative: Column) -> Column:
    """``[service] (N x) label``: label, else summary, else the text's start."""
    shown = F.coalesce(
        non_empty(label), non_empty(summary), F.substring(F.coalesce(representative, F.lit("")), 1, 60)
    )
    return F.format_string(
        "[%s] (%dx) %s", F.coalesce(non_empty(service), F.lit("unknown")), F.coalesce(F.nullif(count, F.lit(0)), F.lit(1)).cast("bigint"), shown
    )


def tooltip_html(representative: Column, count: Column, service: Column, samples: Column) -> Column:
    """Tooltip with up to five escaped samples of 200 characters each."""
    text = F.coalesce(representative, F.lit(""))
    given = F.filter(F.coalesce(samples, F.array().cast("array<string>")), lambda s: s != "")
    shown = F.when((F.size(given) == 0) & (text != ""), F.array(text)).otherwise(given)
    lines = F.transform(
        F.slice(shown, 1, 5),
        lambda s: F.concat(F.lit("&nbsp;&nbsp;• "), escape_markup(F.substring(s, F.lit(1), F.lit(200)))),
    )
    more = F.when(
        F.size(shown) > 5, F.concat(F.lit("<br>&nbsp;&nbsp;… +"), (F.size(shown) - 5).cast("string"), F.lit(" more"))
    ).otherwise("")
    return F.concat(
        F.lit("<b>"),
        escape_markup(F.substring(text, 1, 120)),
        F.lit("</b><br>Service: "),
        escape_markup(F.coalesce(non_empty(service), F.lit("unknown"))),
        F.lit("<br>Occurrences: "),
        F.coalesce(F.nullif(count, F.lit(0)), F.lit(1)).cast("string"),
        F.lit("<br><br><b>Sample logs:</b><br>"),
        F.array_join(lines, "<br>"),
        more,
    )


def described(clusters: DataFrame) -> DataFrame:
    """Adds ``label`` and ``tooltip`` to cluster rows."""
    return clusters.withColumns(
        {
            "label": label_text(
                F.col("service_name"),
                F.col("occurrence_count"),
                F.col("cluster_label"),
                F.col("cluster_summary"),
                F.col("representative_log"),
            ),
            "tooltip": tooltip_html(
                F.col("representative_log"), F.col("occurrence_count"), F.col("service_name"), F.col("sample_logs")
            ),
        }
    )


def projected(points: DataFrame, id_col: str, vector: str = "vector", limit: int | None = None) -> DataFrame:
    """Adds ``x, y``: the first two principal components. With ``limit``
    only so many points are shown, lowest ids first. One or two points lie
    at (0, 0) and (1, 0)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    usable = points.filter(F.size(vector) > 0)
    shown = usable.orderBy(id_col).limit(limit) if limit else usable
    first = [row[0] for row in shown.select(id_col).limit(3).collect()]
    if len(first) <= 2:
        lowest = min(first) if first else None
        x = F.when(F.col(id_col) == F.lit(lowest), 0.0).otherwise(1.0)
        return shown.withColumn("x", x).withColumn("y", F.lit(0.0))
    features = shown.withColumn("__features", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=2, inputCol="__features", outputCol="__pca").fit(features)
    plane = vector_to_array("__pca")
    return (
        model.transform(features)
        .withColumn("__xy", plane)
        .withColumn("x", F.col("__xy")[0])
        .withColumn("y", F.col("__xy")[1])
        .drop("__features", "__pca", "__xy")
    )


def density_grid(points: DataFrame, size: int = GRID, weight: str = "occurrence_count", label: str = "label") -> DataFrame:
    """Points per tile of a ``size`` x ``size`` grid over their bounding box,
    with the label of the tile's heaviest point."""
    box = points.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    boxed = points.withColumn("__box", box.scalar())

    def tile(value: str, low: str, high: str) -> Column:
        spread = F.col(f"__box.{high}") - F.col(f"__box.{low}")
        place = F.floor((F.col(value) - F.col(f"__box.{low}")) / spread * size)
        # The upper edge belongs to the last tile.
        return F.when(spread > 0, F.least(place, F.lit(size - 1))).otherwise(F.lit(0)).cast("int")

    return (
        boxed.withColumns({"gx": tile("x", "x0", "x1"), "gy": tile("y", "y0", "y1")})
        .groupBy("gx", "gy")
        .agg(
            F.count("*").alias("points"),
            F.min_by(label, F.struct((-F.col(weight)).alias("w"), F.col(label))).alias("label"),
        )
    )


def map_lines(points: DataFrame) -> DataFrame:
    """``value``: one JSON array ``[x, y, tooltip]`` per point, ready for
    ``df.write.text``."""
    return points.select(
        F.concat_ws(
            "",
            F.lit("["),
            F.col("x").cast("string"),
            F.lit(", "),
            F.col("y").cast("string"),
            F.lit(", "),
            F.regexp_extract(F.to_json(F.struct(F.col("tooltip").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1),
            F.lit("]"),
        ).alias("value")
    )
