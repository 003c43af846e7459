"""The registered queries of the library and the SQL that states the same results."""

from __future__ import annotations

from quillsieve.plans import group_queries, metric_queries, row_queries, text_queries, unit_queries
from quillsieve.plans.registry import Query

_ALL = (text_queries.query, metric_queries.query, row_queries.query, group_queries.query, unit_queries.query)


def queries() -> dict[str, Query]:
    return {name: f for r in _ALL for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _ALL for name, sql in r.oracles.items()}
