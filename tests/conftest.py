import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4)


@pytest.fixture
def one(spark):
    """Evaluate a column expression on a single row."""
    def evaluate(column):
        return spark.range(1).select(column.alias("v")).first().v
    return evaluate
