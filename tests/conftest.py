import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    s = local_session(cpus=8, shuffle_partitions=2)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return s


@pytest.fixture(scope="session")
def rows(spark):
    """Build a DataFrame from tuples without starting a Python worker."""

    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return make
