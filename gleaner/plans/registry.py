"""Every registered query of the core library, with its SQL."""

from __future__ import annotations

from . import learning_queries, relational_queries, report_queries, run_queries, store_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (text_queries, relational_queries, report_queries, learning_queries, run_queries, store_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
