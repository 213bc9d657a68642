"""Registered queries over the shared tables, with an SQL twin where SQL can
say the same."""

from timberflow.plans.registry import ORACLES, QUERIES  # noqa: F401
from timberflow.plans import (  # noqa: F401
    access_plans,
    alert_plans,
    cluster_plans,
    ingest_plans,
    parse_plans,
    report_plans,
    search_plans,
    text_plans,
)
