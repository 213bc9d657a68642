import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from timberflow.session import build_session

    session = build_session(
        "local[*]",
        "timberflow-tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines(spark):
    """One ``value`` row per given text, in order of ``n``."""

    def make(*texts):
        rows = list(enumerate(texts))
        return spark.createDataFrame(rows, "n int, value string")

    return make
