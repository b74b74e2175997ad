"""All queries of the core, by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from lumenfold.plans import core_problems, relational, series_queries, service_queries, vector_queries

_MODULES = (core_problems, vector_queries, series_queries, relational, service_queries)
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
