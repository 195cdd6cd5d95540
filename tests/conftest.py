import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from potentia.session import get_spark
    s = get_spark(shuffle_partitions=8)
    yield s
    s.stop()


def pts_1d(spark, values, weights=None):
    """Point table from 1-D values with ids 0..n-1."""
    rows = [(i, [float(v)], float(weights[i]) if weights else 1.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, x array<double>, weight double")
