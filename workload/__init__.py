"""The registered queries, each beside the SQL that gives the same result."""

from __future__ import annotations

from workload import aggregates, catalog, charts, cleaning, features, patterns, payload, quality, roles, sources

GROUPS = (roles, sources, cleaning, aggregates, features, quality, patterns, charts, catalog, payload)


def all_queries() -> dict:
    return {name: fn for group in GROUPS for name, fn in group.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
