"""The registered queries of the training-data operators against their SQL."""

import pytest

from quire.llm import catalog
from tests.compare import SF, spark_rows, sql


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == sql(catalog.ORACLES[name])
