"""Queries of the subpackage next to their SQL twins."""

import pytest

from tests.conftest import DATA
from tests.oracle import compare, connect
from timberflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    problem, rows, _ = compare(spark, connect(DATA), name, QUERIES[name], ORACLES[name], DATA)
    assert problem is None and rows > 0
