"""Registered queries and their SQL."""

from __future__ import annotations

from . import document_queries, listing_queries, more_queries, page_queries, table_queries

_MODULES = (page_queries, document_queries, table_queries, more_queries, listing_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
