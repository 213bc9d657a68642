"""Duplicate clusters and the cluster map."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberflow.operators import clustermap as CM, clusters as CL, embedding as EM
from timberflow.plans.registry import document_logs, query, table
from timberflow.plans.text_plans import _SEVERITY, _masked_sql

# Documents arrive in order of their id.
_GROUPS = f"""
WITH d AS (SELECT doc_id, source, text, {_masked_sql('text')} AS norm FROM documents),
g AS (SELECT doc_id, source, text, norm, sha256(norm) AS key, min(doc_id) OVER (PARTITION BY norm) AS first_id FROM d WHERE norm <> '')"""


@query(
    "exact_text_clusters",
    _GROUPS
    + """ SELECT key AS text_key, count(*) AS occurrence_count, min(doc_id) AS first_log_id, md5(arg_min(text, doc_id)) AS representative_md5,
  min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM g GROUP BY key""",
)
def exact_text_clusters(spark, sf_dir):
    logs = document_logs(spark, sf_dir).withColumn("ts", F.col("log_id"))
    groups = CL.exact_text_groups(logs)
    return groups.withColumn("representative_md5", F.md5("representative_log")).drop("representative_log")


def exact_decisions(spark, sf_dir):
    """Cluster decisions for equal normalised texts: each repeat scores 1.
    Clusters and decisions read the rows several times, so the normalised keys
    are stored: the texts are masked once."""
    from timberflow.functions.masks import normalized_text
    from timberflow.operators.pinning import pin
    from timberflow.session import stored

    keyed = pin(
        document_logs(spark, sf_dir).withColumn("ts", F.col("log_id")),
        {"text_key": F.sha2(normalized_text(F.col("message")), 256)},
    )
    logs = stored(keyed, "keyed-logs")
    firsts = logs.groupBy("text_key").agg(F.min("log_id").alias("first_id"))
    return (
        logs.join(firsts, "text_key")
        .withColumn("is_duplicate", F.col("log_id") != F.col("first_id"))
        .withColumn("similarity_score", F.col("is_duplicate").cast("double"))
        .withColumnRenamed("text_key", "cluster_id")
        .drop("first_id")
    )


@query(
    "cluster_table",
    _GROUPS
    + """ SELECT key AS cluster_id, count(*) AS occurrence_count, min(doc_id) AS first_seen, max(doc_id) AS last_seen,
  arg_min(source, doc_id) AS service_name, md5(arg_min(trim(text, e' \\t\\n\\r'), doc_id)) AS representative_md5,
  CASE WHEN count(*) > 1 THEN 1.0 ELSE 0.0 END AS similarity_score_average,
  CAST(least(5, count(DISTINCT trim(text, e' \\t\\n\\r'))) AS INT) AS sample_count,
  (SELECT md5(t) FROM (SELECT trim(h.text, e' \\t\\n\\r') AS t, min(h.doc_id) AS seen FROM g h WHERE h.key = g.key GROUP BY 1 ORDER BY seen DESC LIMIT 1)) AS newest_sample_md5
FROM g GROUP BY key""",
)
def cluster_table(spark, sf_dir):
    clusters = CL.cluster_table(exact_decisions(spark, sf_dir))
    return clusters.select(
        "cluster_id",
        "occurrence_count",
        "first_seen",
        "last_seen",
        "service_name",
        F.md5("representative_log").alias("representative_md5"),
        "similarity_score_average",
        F.size("sample_logs").alias("sample_count"),
        F.md5(F.col("sample_logs")[0]).alias("newest_sample_md5"),
    )


_SUMMARY = """
c AS (SELECT key, count(*) AS n, arg_min(source, doc_id) AS service_name, arg_min(norm, doc_id) AS norm FROM g GROUP BY key),
x AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(norm, '(?i)^(error|warn|warning|critical|info)\\s*[:\\-\\s]*', ''),
   '(?i)\\b(?:0x)?[a-f0-9]{6,}\\b', '', 'g'), '\\b\\d+\\b', '', 'g'), '\\s+', ' ', 'g'), e' \\t\\n\\r') AS cleaned,
   """ + _SEVERITY.replace("{t}", "norm") + """ AS severity FROM c)"""


@query(
    "cluster_statistics",
    _GROUPS
    + ","
    + _SUMMARY
    + """ SELECT key AS cluster_id, n AS occurrence_count,
  CASE WHEN cleaned = '' THEN substr(norm, 1, 160) ELSE upper(substr(severity, 1, 1)) ||
    CASE severity WHEN 'warn' THEN 'arning' ELSE substr(severity, 2) END || ' cluster: ' || substr(cleaned, 1, 120) END AS cluster_summary,
  CASE WHEN n > 1 THEN round((n - 1) * 100.0 / (SELECT sum(n) FROM c), 2) ELSE 0.0 END AS duplicate_reduction_percentage,
  service_name || ':' || key AS cluster_label, CASE WHEN n > 1 THEN 'duplicate' ELSE 'new' END AS status, severity FROM x""",
)
def cluster_statistics(spark, sf_dir):
    stats = CL.cluster_statistics(CL.cluster_table(exact_decisions(spark, sf_dir)))
    return stats.select(
        "cluster_id",
        "occurrence_count",
        "cluster_summary",
        "duplicate_reduction_percentage",
        "cluster_label",
        "visualization_metadata.status",
        "visualization_metadata.severity",
    )


@query("indexed_logs", _GROUPS + " SELECT doc_id AS log_id, key AS cluster_id FROM g WHERE doc_id = first_id")
def indexed_logs(spark, sf_dir):
    return CL.indexed_logs(exact_decisions(spark, sf_dir)).select("log_id", "cluster_id")


@query(
    "cluster_decisions",
    _GROUPS
    + """ SELECT doc_id AS log_id, key AS cluster_id, doc_id <> first_id AS is_duplicate,
  CASE WHEN doc_id <> first_id THEN 1.0 ELSE 0.0 END AS similarity_score, count(*) OVER (PARTITION BY key) AS occurrence_count FROM g""",
)
def cluster_decisions(spark, sf_dir):
    decisions = exact_decisions(spark, sf_dir)
    rows = CL.decision_rows(decisions, CL.cluster_table(decisions))
    return rows.select("log_id", "cluster_id", "is_duplicate", "similarity_score", "occurrence_count")


@query(
    "cluster_defaults",
    _GROUPS
    + """ SELECT key AS cluster_id, CASE WHEN count(*) > 1 THEN count(*) ELSE 1 END AS occurrence_count, min(doc_id) AS last_seen,
  0.0::DOUBLE AS similarity_score_average, '' AS cluster_summary, 0 AS sample_count FROM g GROUP BY key""",
)
def cluster_defaults(spark, sf_dir):
    """Stored rows with holes, read back with their defaults."""
    groups = CL.exact_text_groups(document_logs(spark, sf_dir).withColumn("ts", F.col("log_id")))
    holes = groups.select(
        F.col("text_key").alias("cluster_id"),
        F.when(F.col("occurrence_count") > 1, F.col("occurrence_count")).otherwise(0).alias("occurrence_count"),
        "first_seen",
        F.lit(None).cast("bigint").alias("last_seen"),
        F.lit(None).cast("array<string>").alias("sample_logs"),
        F.lit(None).cast("double").alias("similarity_score_average"),
        F.lit(None).cast("string").alias("cluster_summary"),
        F.lit(None).cast("double").alias("duplicate_reduction_percentage"),
    )
    filled = CL.with_cluster_defaults(holes)
    return filled.select(
        "cluster_id",
        "occurrence_count",
        "last_seen",
        "similarity_score_average",
        "cluster_summary",
        F.size("sample_logs").alias("sample_count"),
    )


@query("semantic_clusters")
def semantic_clusters(spark, sf_dir):
    """Leader clustering of the documents' hashed vectors. Texts are embedded
    once and stored as vectors; of a text the clusters only read whether it is
    blank, which its first character that is not tells."""
    from timberflow.functions.text import WHITESPACE
    from timberflow.session import stored

    start = F.substring(F.ltrim(F.col("message"), F.lit(WHITESPACE)), 1, 1)
    logs = document_logs(spark, sf_dir).withColumns({"ts": F.col("log_id"), "start": start})
    embedded = EM.embed_texts(logs, "message", EM.hashing_embedder(256))
    embedded = stored(embedded.select("log_id", "ts", F.col("start").alias("message"), "vector"), "embedded")
    decided = CL.assign_clusters(embedded, threshold=0.92)
    return decided.select("log_id", "cluster_id", "is_duplicate", F.round("similarity_score", 6).alias("similarity_score"))


@query("semantic_vector_clusters")
def semantic_vector_clusters(spark, sf_dir):
    """Leader clustering of the stored vectors at a low threshold."""
    logs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("log_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("ts"), F.lit("m").alias("message")
    )
    decided = CL.assign_clusters(logs, threshold=0.4)
    return decided.select("log_id", "cluster_id", "is_duplicate", F.round("similarity_score", 6).alias("similarity_score"))


@query(
    "cluster_labels",
    _GROUPS
    + ","
    + _SUMMARY
    + """ SELECT key AS cluster_id, '[' || service_name || '] (' || n || 'x) ' || CASE WHEN n > 1 THEN service_name || ':' || key
  ELSE (SELECT substr(arg_min(trim(text, e' \\t\\n\\r'), doc_id), 1, 60) FROM g WHERE g.key = x.key) END AS label FROM x""",
)
def cluster_labels(spark, sf_dir):
    """Repeated clusters show their label, single ones their text."""
    clusters = CL.cluster_table(exact_decisions(spark, sf_dir))
    label = CL.cluster_label(F.col("service_name"), F.col("cluster_id"))
    shown = CM.label_text(
        F.col("service_name"),
        F.col("occurrence_count"),
        F.when(F.col("occurrence_count") > 1, label),
        F.lit(""),
        F.col("representative_log"),
    )
    return clusters.select("cluster_id", shown.alias("label"))


_ESC = "replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    "cluster_tooltips",
    f"""SELECT page_id, md5('<b>' || {_ESC.replace('{t}', 'substr(html, 1, 120)')} || '</b><br>Service: ' || {_ESC.replace('{t}', 'url')}
  || '<br>Occurrences: ' || length(url) || '<br><br><b>Sample logs:</b><br>' || '&nbsp;&nbsp;• ' || {_ESC.replace('{t}', 'substr(html, 1, 200)')}
  || repeat('<br>&nbsp;&nbsp;• ' || {_ESC.replace('{t}', 'substr(url, 1, 200)')}, 4) || '<br>&nbsp;&nbsp;… +1 more') AS tooltip_md5 FROM pages""",
)
def cluster_tooltips(spark, sf_dir):
    samples = F.concat(F.array("html"), F.array_repeat("url", 5))
    tooltip = CM.tooltip_html(F.col("html"), F.length("url"), F.col("url"), samples)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tooltip).alias("tooltip_md5"))


@query(
    "cluster_grid",
    """WITH p AS (SELECT vec_id, label AS weight, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
t AS (SELECT p.*, CAST(least(79, floor((x - x0) / (x1 - x0) * 80)) AS INT) AS gx, CAST(least(79, floor((y - y0) / (y1 - y0) * 80)) AS INT) AS gy FROM p, b)
SELECT gx, gy, count(*) AS points, arg_min('p' || vec_id, (-weight, 'p' || vec_id)) AS label FROM t GROUP BY ALL""",
)
def cluster_grid(spark, sf_dir):
    vector = F.col("embedding")
    points = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("label"),
        F.col("label").alias("occurrence_count"),
        vector[0].cast("double").alias("x"),
        vector[1].cast("double").alias("y"),
    )
    return CM.density_grid(points)


def _projected(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cluster_id"), F.col("embedding").alias("vector"))
    return CM.projected(points, "cluster_id")


@query("cluster_projection")
def cluster_projection(spark, sf_dir):
    return _projected(spark, sf_dir).select("cluster_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("cluster_map_lines")
def cluster_map_lines(spark, sf_dir):
    tooltip = F.concat(F.lit("<b>"), F.col("cluster_id").cast("string"), F.lit("</b>"))
    rows = _projected(spark, sf_dir).withColumns({"tooltip": tooltip, "x": F.round("x", 4), "y": F.round("y", 4)})
    return CM.map_lines(rows)
