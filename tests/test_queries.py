"""Every query of the library against its SQL, over whole tables."""

import pytest

from samelode import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, same):
    same(QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
