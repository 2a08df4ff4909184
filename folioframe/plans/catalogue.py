"""Every registered query of the document engine, and the SQL that must agree with it."""

from __future__ import annotations

from folioframe.plans import geometry_queries, markup_queries, system_queries

_PARTS = (geometry_queries, markup_queries, system_queries)


def queries() -> dict:
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
