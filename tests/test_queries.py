"""Every resolution query gives the rows of its SQL; the others give rows."""

import pytest
from duck import rows, spark_rows

from recordloom import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == rows(queries.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_gives_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
