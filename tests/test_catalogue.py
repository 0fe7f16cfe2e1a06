"""Every query with an SQL twin gives the same rows as DuckDB on the small tables; the
others are tested in test_values."""

import os

import pytest

from scoreloom.plans import catalogue
from scoreloom.plans.ship import ship
from tests.compare import DATA, differences

BASE = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, name):
    ship(spark)
    assert differences(spark, name, catalogue.QUERIES[name], catalogue.SQL[name], BASE) is None


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalogue.FLAGSHIP in e.queries()
