"""Vector search, root-cause context and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberflow.operators import embedding as EM, rootcause as RC, search as SR
from timberflow.plans.registry import document_logs, event_logs, query, table
from timberflow.session import stored

_VECTORS = """
v AS (SELECT vec_id AS log_id, CAST(embedding AS DOUBLE[]) AS vec, 'svc-' || label % 4 AS service_id,
  CASE WHEN label % 3 = 0 THEN 'prod' ELSE 'test' END AS environment,
  CASE WHEN label % 2 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, 'message ' || vec_id AS message,
  'raw ' || vec_id AS raw, CASE WHEN label % 5 = 0 THEN NULL ELSE '2024-01-01T00:00:00' END AS timestamp FROM embeddings)"""


def vector_logs(spark, sf_dir):
    """``embeddings`` as indexed logs."""
    label, vec_id = F.col("label"), F.col("vec_id").cast("string")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("log_id"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("svc-"), (label % 4).cast("string")).alias("service_id"),
        F.when(label % 3 == 0, "prod").otherwise("test").alias("environment"),
        F.when(label % 2 == 0, "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("message "), vec_id).alias("message"),
        F.concat(F.lit("raw "), vec_id).alias("raw"),
        F.when(label % 5 != 0, "2024-01-01T00:00:00").alias("timestamp"),
    )


def _probe(spark, sf_dir):
    """The vector of the first log is what the single searches look for."""
    return list(vector_logs(spark, sf_dir).orderBy("log_id").first()["vector"])


_SCORED = (
    "WITH"
    + _VECTORS
    + ", s AS (SELECT *, list_cosine_similarity(vec, (SELECT vec FROM v ORDER BY log_id LIMIT 1)) AS score FROM v)"
)


def _rounded(df, *keep):
    return df.select(*keep, F.round("score", 6).alias("score"))


@query(
    "topk_search",
    _SCORED + " SELECT log_id, service_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, log_id LIMIT 50",
)
def topk_search(spark, sf_dir):
    return _rounded(SR.top_k(vector_logs(spark, sf_dir), _probe(spark, sf_dir), 50), "log_id", "service_id")


@query(
    "scoped_topk_search",
    _SCORED
    + """ SELECT log_id, round(score, 6) AS score FROM s WHERE service_id = 'svc-2' AND environment = 'prod' AND level = 'ERROR'
ORDER BY s.score DESC, log_id LIMIT 10""",
)
def scoped_topk_search(spark, sf_dir):
    base = SR.scoped(vector_logs(spark, sf_dir), " svc-2 ", "prod", "error")
    return _rounded(SR.top_k(base, _probe(spark, sf_dir), 10), "log_id")


@query(
    "optional_scope_search",
    _SCORED + " SELECT log_id, service_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, log_id LIMIT 10",
)
def optional_scope_search(spark, sf_dir):
    base = SR.optionally_scoped(vector_logs(spark, sf_dir), "  ")
    return _rounded(SR.top_k(base, _probe(spark, sf_dir), 10), "log_id", "service_id")


@query(
    "threshold_search",
    _SCORED + " SELECT log_id, round(score, 6) AS score FROM s WHERE score >= 0.15 ORDER BY s.score DESC, log_id LIMIT 50",
)
def threshold_search(spark, sf_dir):
    return _rounded(SR.top_k(vector_logs(spark, sf_dir), _probe(spark, sf_dir), 50, min_score=0.15), "log_id")


def _queries(spark, sf_dir):
    return vector_logs(spark, sf_dir).select(
        F.col("log_id").alias("query_id"), F.col("vector").alias("query_vector"), "service_id"
    )


_PAIRS = (
    "WITH"
    + _VECTORS
    + """, p AS (SELECT q.log_id AS query_id, b.log_id, b.level, b.message, b.timestamp, b.service_id, b.raw, q.service_id AS wanted,
  list_cosine_similarity(q.vec, b.vec) AS score FROM v q CROSS JOIN v b)"""
)


@query(
    "knn_join",
    _PAIRS
    + """ SELECT query_id, log_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, log_id) AS rank FROM p) WHERE rank <= 5""",
)
def knn_join(spark, sf_dir):
    found = SR.nearest(vector_logs(spark, sf_dir), _queries(spark, sf_dir).drop("service_id"), 5)
    return _rounded(found, "query_id", "log_id", "rank")


@query(
    "knn_join_scoped",
    _PAIRS
    + """ SELECT query_id, log_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, log_id) AS rank FROM p
  WHERE service_id = wanted AND score >= 0.1) WHERE rank <= 3""",
)
def knn_join_scoped(spark, sf_dir):
    found = SR.nearest(
        vector_logs(spark, sf_dir), _queries(spark, sf_dir), 3, scope_col="service_id", min_score=0.1, split=300
    )
    return _rounded(found, "query_id", "log_id", "rank")


@query(
    "upsert_points",
    "WITH"
    + _VECTORS
    + """ SELECT log_id, CASE WHEN level = 'ERROR' AND service_id <> 'svc-3' THEN 'new' ELSE 'old' END AS state FROM v""",
)
def upsert_points(spark, sf_dir):
    """Rewrite the error logs; those of one service arrive malformed."""
    stored = vector_logs(spark, sf_dir).select("log_id", "service_id", "level").withColumns(
        {"ts": F.lit(1), "state": F.lit("old")}
    )
    incoming = stored.filter("level = 'ERROR'").withColumns(
        {
            "ts": F.lit(0),
            "state": F.lit("new"),
            "service_id": F.when(F.col("service_id") == "svc-3", "bad service").otherwise(F.col("service_id")),
        }
    )
    return SR.upsert_points(stored, incoming).select("log_id", "state")


@query(
    "rejected_points",
    "WITH" + _VECTORS + " SELECT log_id, 'log payload must include a valid service_id' AS error FROM v WHERE service_id = 'svc-3'",
)
def rejected_points(spark, sf_dir):
    bad = F.when(F.col("service_id") == "svc-3", "bad service").otherwise(F.col("service_id"))
    return SR.rejected_points(vector_logs(spark, sf_dir).withColumn("service_id", bad)).select("log_id", "error")


@query(
    "stored_payload",
    "WITH"
    + _VECTORS
    + """ SELECT log_id, level, CASE WHEN level = 'ERROR' THEN service_id WHEN environment = 'prod' THEN 'otel' ELSE 'unknown_service' END AS service_id FROM v""",
)
def stored_payload(spark, sf_dir):
    metadata = F.create_map(
        F.lit("service"), F.when(F.col("level") == "ERROR", F.col("service_id")).otherwise(""),
        F.lit("service.name"), F.when(F.col("environment") == "prod", "otel"),
    )
    parsed = vector_logs(spark, sf_dir).withColumns({"metadata_kv": metadata, "level": F.lower("level")})
    return SR.stored_payload(parsed).select("log_id", "level", "service_id")


@query(
    "context_lines",
    _PAIRS
    + """ SELECT query_id, string_agg('- [' || coalesce(timestamp, 'None') || '] ' || level || ': ' || message || ' (Raw: ' || raw || ')', e'\\n' ORDER BY rank) AS log_context
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, log_id) AS rank FROM p) WHERE rank <= 3 GROUP BY 1""",
)
def context_lines(spark, sf_dir):
    hits = SR.nearest(vector_logs(spark, sf_dir), _queries(spark, sf_dir).drop("service_id"), 3)
    return SR.answer_context(hits, "query_id")


@query(
    "search_prompts",
    _PAIRS
    + """ SELECT query_id, md5('You are an expert system reliability assistant for this system.' || chr(10)
 || 'Based on the following relevant system logs, answer the user''s natural language query.' || chr(10)
 || 'Be concise, helpful, and technically accurate.' || chr(10) || chr(10) || 'Query: "why ' || query_id || '"' || chr(10) || chr(10)
 || 'Logs:' || chr(10) || string_agg('- [' || coalesce(timestamp, 'None') || '] ' || level || ': ' || message || ' (Raw: ' || raw || ')', e'\\n' ORDER BY rank)
 || chr(10) || chr(10) || 'Answer:') AS prompt_md5
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, log_id) AS rank FROM p) WHERE rank <= 3 GROUP BY query_id""",
)
def search_prompts(spark, sf_dir):
    answers = context_lines(spark, sf_dir).withColumn("query", F.concat(F.lit("why "), F.col("query_id").cast("string")))
    return RC.search_prompts(answers).select("query_id", F.md5("prompt").alias("prompt_md5"))


# Root cause: error logs ask, info logs are the remembered incidents.
_ASK = _PAIRS.replace("FROM v q CROSS JOIN v b)", "FROM v q CROSS JOIN v b WHERE q.level = 'ERROR')") + """,
best AS (SELECT query_id, log_id AS incident_id, score FROM p WHERE level = 'INFO'
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, log_id) = 1),
ctx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, log_id) AS rank FROM p
  WHERE service_id = wanted AND query_id IN (SELECT query_id FROM best WHERE score < 0.35) QUALIFY rank <= 5)"""


def _requests(spark, sf_dir):
    return vector_logs(spark, sf_dir).filter("level = 'ERROR'").select(
        F.col("log_id").alias("query_id"),
        F.col("vector").alias("query_vector"),
        "service_id",
        F.concat(F.lit("failure of "), "message").alias("error_message"),
    )


def _incidents(spark, sf_dir):
    return vector_logs(spark, sf_dir).filter("level = 'INFO'").select(
        F.col("log_id").alias("incident_id"), "vector", F.concat(F.lit("because "), "message").alias("explanation")
    )


def _looked_up(spark, sf_dir):
    return RC.incident_lookup(_requests(spark, sf_dir), _incidents(spark, sf_dir), 0.35)


@query(
    "incident_cache_lookup",
    _ASK
    + """ SELECT query_id, incident_id, round(score, 6) AS score, score >= 0.35 AS reused,
  CASE WHEN score >= 0.35 THEN 'because message ' || incident_id END AS explanation,
  CASE WHEN score >= 0.35 THEN 'model (cached)' ELSE 'model' END AS model FROM best""",
)
def incident_cache_lookup(spark, sf_dir):
    found = _looked_up(spark, sf_dir).withColumnRenamed("incident_score", "score")
    return _rounded(found, "query_id", "incident_id", "reused", "explanation", "model")


def _context(spark, sf_dir):
    misses = stored(_looked_up(spark, sf_dir).filter("not reused"), "misses")  # read for the context and the prompts
    return misses, RC.retrieve_context(misses, vector_logs(spark, sf_dir), 5, scoped=True)


@query(
    "rca_context",
    _ASK + " SELECT query_id, log_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM ctx",
)
def rca_context(spark, sf_dir):
    return _rounded(_context(spark, sf_dir)[1], "query_id", "log_id", "rank")


@query(
    "rca_prompt",
    _ASK
    + """ SELECT query_id, 'Context logs from the system:' || chr(10)
  || string_agg('  [' || rank || '] [' || level || '] ' || coalesce(timestamp, 'unknown time') || ' (service: ' || service_id || '): ' || message, chr(10) ORDER BY rank)
  || chr(10) || chr(10) || 'Error to explain:' || chr(10) || 'failure of message ' || query_id AS prompt,
  CAST(count(*) AS INT) AS context_logs FROM ctx GROUP BY query_id""",
)
def rca_prompt(spark, sf_dir):
    misses, context = _context(spark, sf_dir)
    return RC.explain_prompts(misses, context).select("query_id", "prompt", "context_logs")


@query(
    "new_incidents",
    """SELECT sha256('failure of message ' || vec_id || chr(31) || 'found ' || vec_id || chr(31) || 'svc-' || label % 4) AS incident_id
FROM embeddings WHERE label % 2 = 0 AND label % 4 = 0""",
)
def new_incidents(spark, sf_dir):
    """Explanations for one service only; the blank ones are not remembered."""
    asked = _requests(spark, sf_dir).withColumn("prompt", F.concat_ws("|", "service_id", "query_id"))
    answer = lambda p: F.when(p.startswith("svc-0|"), F.concat(F.lit("found "), F.substring_index(p, "|", -1))).otherwise("  ")
    return RC.new_incidents(RC.complete(asked, answer)).select("incident_id")


@query(
    "cache_hit_rate",
    """SELECT count(*) AS requests, count(DISTINCT sha256(text)) AS misses,
  round(1 - count(DISTINCT sha256(text)) / count(*), 9) AS hit_rate FROM documents""",
)
def cache_hit_rate(spark, sf_dir):
    rate = EM.cache_hit_rate(table(spark, sf_dir, "documents"), "text")
    return rate.select(F.col("requests").cast("bigint").alias("requests"), "misses", F.round("hit_rate", 9).alias("hit_rate"))


@query("embed_distinct_texts")
def embed_distinct_texts(spark, sf_dir):
    embedded = EM.embed_texts(document_logs(spark, sf_dir), "message", EM.hashing_embedder(64))
    return embedded.select("log_id", "service_id", F.size("vector").alias("dimensions"), F.round(F.col("vector")[0], 5).alias("first_value"))


@query(
    "processed_rows",
    """SELECT event_id AS log_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE WHEN event_type = 'click' THEN 'queue text' ELSE props END AS message,
  CASE WHEN event_type = 'view' THEN 'viewer' ELSE 'unknown' END AS service_id,
  CASE WHEN event_type = 'signup' THEN 'NOW' ELSE 'T' || event_id END AS timestamp FROM events""",
)
def processed_rows(spark, sf_dir):
    kind = F.col("event_type")
    rows = event_logs(spark, sf_dir).select(
        F.struct(
            F.when(kind != "signup", F.concat(F.lit("T"), F.col("log_id").cast("string"))).alias("timestamp"),
            F.when(kind == "error", "ERROR").alias("level"),
            F.when(kind != "click", F.col("props")).alias("message"),
        ).alias("parsed"),
        F.lit("queue text").alias("message"),
        F.create_map(F.lit("service"), F.when(kind == "view", "viewer"), F.lit("log_id"), F.col("log_id").cast("string")).alias("metadata"),
        F.lit("raw_input").alias("parser_type"),
    )
    shaped = EM.processed_rows(rows, F.lit("NOW"))
    return shaped.select(
        F.col("metadata")["log_id"].cast("bigint").alias("log_id"), "level", "message", "service_id", "timestamp"
    )


@query("partition_statistics")
def partition_statistics(spark, sf_dir):
    return EM.partition_statistics(event_logs(spark, sf_dir).repartition(4, "log_id"))
