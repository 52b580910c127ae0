"""The queries by name, each with its SQL where SQL can say it."""

from __future__ import annotations

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    """Register a query (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
