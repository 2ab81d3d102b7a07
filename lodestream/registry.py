"""How a module of plans registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[Callable, dict[str, Query], dict[str, str]]:
    """(query, QUERIES, ORACLES): ``@query(sql)`` registers a function, and its DuckDB form over the corpus views if it has one."""
    from lodestream.corpus import VIEWS

    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if f.__name__ in queries:
                raise ValueError(f"{f.__name__} is registered twice")
            queries[f.__name__] = f
            if sql:
                body = sql.strip()
                oracles[f.__name__] = f"WITH RECURSIVE {VIEWS}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH RECURSIVE {VIEWS} {body}"
            return f

        return add

    return query, queries, oracles
