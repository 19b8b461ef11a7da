"""Every query with a DuckDB counterpart returns the same columns and rows."""

import pytest

from casemill.plans.registry import ORACLE_SQL, QUERIES
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_duckdb(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) == ""
