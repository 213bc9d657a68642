import pytest

from tests.conftest import DATA
from tests.oracle import compare, connect
from timberflow.plans import ORACLES, QUERIES

# A quick cross-section; tests/oracle.py runs them all.
SAMPLE = (
    "error_rate_anomalies",
    "alert_matches",
    "redaction_counts",
    "normalize_timestamps",
    "parse_lines",
    "parse_multi_format",
    "knn_join_scoped",
    "rca_prompt",
    "cluster_table",
    "dashboard_summary",
    "latency_metrics",
    "access_checks",
    "otlp_flatten",
    "dead_letters",
)


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    problem, _rows, _seconds = compare(spark, duck, name, QUERIES[name], ORACLES[name], DATA)
    assert problem is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_filters_reach_the_scan(spark):
    from timberflow.operators import reports
    from timberflow.plans.registry import event_logs

    page = reports.log_page(event_logs(spark, DATA), 1, 10, None, "2024-01-05 00:00:00", None)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "TakeOrderedAndProject" in plan


def test_pinned_columns_let_other_filters_through(spark):
    from pyspark.sql import functions as F
    from timberflow.operators.parsing import parse_lines

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.col("text").alias("value"))
    plan = parse_lines(docs).filter("doc_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,3)" in plan


def test_input_is_dealt_by_setting_alone(spark):
    from timberflow.plans.registry import INPUT_PARTITIONS, spread

    one = spark.range(0, 10, 1, 1)
    assert spread(one).rdd.getNumPartitions() == 1
    spark.conf.set(INPUT_PARTITIONS, "3")
    try:
        assert spread(one).rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(INPUT_PARTITIONS)


def test_cluster_queries_mask_texts_once(spark):
    plan = QUERIES["cluster_decisions"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # the keys are read from where they were stored
