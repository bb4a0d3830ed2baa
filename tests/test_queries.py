"""Every registered query of the panel library against its SQL, on the smallest tables."""

import pytest
from conftest import SF
from same import assert_same

from tessera import function_queries, history_queries, market_queries

QUERIES = history_queries.QUERIES | market_queries.QUERIES | function_queries.QUERIES
ORACLES = history_queries.ORACLES | market_queries.ORACLES | function_queries.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
