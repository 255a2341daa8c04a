"""Every library query that SQL can express, against DuckDB on the same tables."""

import pytest
from rillflow.plans import registry

from tests.compare import oracle_rows, spark_rows

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, name):
    assert spark_rows(registry.queries()[name](spark, sf_dir)) == oracle_rows(ORACLES[name], sf_dir)
