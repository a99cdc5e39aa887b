"""Every registered query at the smallest scale, next to its SQL."""

import pytest

from conftest import SF
from oracle import compare, connect
from wxspark.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 5 and df.columns == ["station", "n", "mae", "rmse"]
