"""All queries of the reference's operators by name, with their SQL."""

from __future__ import annotations

from weftline.plans import detail_queries, record_queries, request_queries, service_queries, session_queries, text_queries

MODULES = (session_queries, text_queries, record_queries, detail_queries, request_queries, service_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
