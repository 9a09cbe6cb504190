"""Every query over the given tables equals its SQL."""

import pytest

from siltstone import registry
from tests.conftest import against_duckdb

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, small, name):
    against_duckdb(registry.queries()[name](spark, small), SQL[name], small)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
