"""Every registered query of the pattern engine, with its SQL for DuckDB."""

from __future__ import annotations

from . import batch_queries, flow_queries, score_queries

QUERIES = batch_queries.QUERIES | flow_queries.QUERIES | score_queries.QUERIES
SQL = batch_queries.SQL | flow_queries.SQL | score_queries.SQL
