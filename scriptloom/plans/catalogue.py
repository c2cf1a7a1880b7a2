"""All queries of the core and their SQL."""

from __future__ import annotations

from . import model_queries, nested_scripts, relational_queries, report_queries, script_queries

QUERIES = {**nested_scripts.QUERIES, **relational_queries.query.queries, **script_queries.query.queries, **model_queries.query.queries, **report_queries.query.queries}
ORACLE_SQL = {**nested_scripts.ORACLE_SQL, **relational_queries.query.sql, **script_queries.query.sql, **model_queries.query.sql, **report_queries.query.sql}
