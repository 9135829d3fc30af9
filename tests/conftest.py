import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fieldcast.session import get_spark
    s = get_spark("tests", master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    from fieldcast.sources.fixtures import Tables
    return Tables(spark, SMOKE)


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
