"""Training-data queries that SQL can express return the same rows there."""

import pytest

from casemill.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_duckdb(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) == ""
