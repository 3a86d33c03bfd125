"""The named queries of the relatedness engine and their DuckDB equivalents."""

from __future__ import annotations

from relspark.plans import taxonomy_queries, text_queries

QUERIES = taxonomy_queries.QUERIES | text_queries.QUERIES
ORACLE_SQL = taxonomy_queries.ORACLE_SQL | text_queries.ORACLE_SQL
