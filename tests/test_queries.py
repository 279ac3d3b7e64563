"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from sievemill.plans import cases
from sievemill.plans import queries as engine

SQL = engine.SQL | cases.SQL
ALL = engine.QUERIES | cases.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(compare, name):
    compare(ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert ALL[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_entry_module_names_every_query(spark):
    import __spark_entry__ as entry

    assert set(ALL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25
