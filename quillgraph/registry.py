"""Registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations


def _modules():
    from .plans import answer_queries, graph_queries, text_queries

    return (text_queries, graph_queries, answer_queries)


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.CATALOG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.CATALOG.sql.items()}
