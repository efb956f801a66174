import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logwarden.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def lines(spark):
    def make(log_type, *texts):
        rows = [(1, i + 1, t, log_type) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "log_id long, line_number int, raw_line string, log_type string")

    return make
