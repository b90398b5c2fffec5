"""Every core query with SQL gives the same rows as DuckDB; the others run."""

from __future__ import annotations

import pytest
from compare import connect, differences

from linkharbor.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, small, name):
    df = registry.queries()[name](spark, small)
    if name in SQL:
        assert differences(df, con, SQL[name]) == ""
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
