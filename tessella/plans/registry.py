"""Named queries, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; {view} in its SQL names a conformed view."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            text = sql
            for name, body in views.SQL.items():
                text = text.replace("{" + name + "}", f"({body})")
            # count_if gives a HUGEINT.
            SQL[f.__name__] = text.strip().replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return register
