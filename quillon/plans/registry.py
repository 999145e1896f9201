"""Where plans put their queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Registers a function under its name, with its SQL counterpart if there is one."""

        def put(f: Query) -> Query:
            self.queries[name or f.__name__] = f
            if sql:
                self.oracles[name or f.__name__] = sql
            return f

        return put
