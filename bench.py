"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` picks the data, ``BENCH_CPUS`` the local threads. Each query
runs once to warm up (class loading, code generation) and is then timed with
all its rows written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "error_rate_anomalies",
    "trailing_error_counts",
    "alert_dedup",
    "redact_documents",
    "redaction_summary",
    "mask_sensitive",
    "normalized_text",
    "normalize_timestamps",
    "parse_lines",
    "parse_multi_format",
    "ingest_structured_records",
    "otlp_flatten",
    "topk_search",
    "knn_join",
    "rca_prompt",
    "exact_text_clusters",
    "semantic_vector_clusters",
    "dashboard_summary",
    "latency_metrics",
    "access_checks",
)


def main() -> None:
    from timberflow.plans import QUERIES
    from timberflow.plans.registry import INPUT_PARTITIONS
    from timberflow.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "timberflow-bench",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            INPUT_PARTITIONS: cpus if cpus.isdigit() else "8",  # a table is one file of one row group
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
