"""All queries of the library outside the training-data subpackage, with their DuckDB counterparts."""

from __future__ import annotations

from casemill.plans import facts_queries, gaps_queries, logs_queries, routing_queries, score_queries, source_queries, text_queries
from casemill.plans.fixtures import oracle

MODULES = (score_queries, logs_queries, text_queries, facts_queries, source_queries, routing_queries, gaps_queries)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: oracle(sql) for m in MODULES for name, sql in m.SQL.items()}
