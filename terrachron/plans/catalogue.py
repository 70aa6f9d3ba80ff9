"""Every registered query with its SQL twin."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict = {}


def register(name, sql=None):
    """Add a query; sql: the same rows in DuckDB, where SQL can express them."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
