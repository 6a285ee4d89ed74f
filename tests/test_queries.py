"""Every query of the layout catalog against its SQL in DuckDB."""

import pytest

from quire.plans import catalog
from tests.compare import SF, spark_rows, sql


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    columns, rows = spark_rows(catalog.QUERIES[name](spark, SF))
    assert rows
    if name in catalog.ORACLES:
        assert (columns, rows) == sql(catalog.ORACLES[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
