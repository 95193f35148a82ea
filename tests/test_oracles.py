"""Every registered query against its independent SQL, all values."""

import pytest
from compare import difference, duck, spark_rows, sql_rows

from reflexgrid.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck("sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    got = spark_rows(QUERIES[name](spark, sf))
    assert got[1]
    if name in ORACLES:
        assert difference(got, sql_rows(con, ORACLES[name])) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
