"""Named queries and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under its name, with the SQL it must equal."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def r6(column: str, alias: str | None = None, digits: int = 6):
    """A rounded column without negative zero, for results that two engines compare."""
    from pyspark.sql import functions as F

    return (F.round(column, digits) + 0.0).alias(alias or (column if isinstance(column, str) else None))


def sql6(expression: str, alias: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {alias}"
