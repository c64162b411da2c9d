"""Every query with SQL against DuckDB, to the last digit given."""

import oracle
import pytest

from furlong.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    assert oracle.differences(registry.queries()[name](spark, SF), oracle.connection(SF), registry.oracle_sql()[name]) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
