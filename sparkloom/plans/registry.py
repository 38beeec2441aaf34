"""Registry of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
Oracle = str | Callable[[], str | None]  # text, or what makes it where the text depends on fixed tables


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, Oracle] = {}

    def add(self, name: str, oracle: Oracle | None = None) -> Callable[[Query], Query]:
        """Decorator: registers a query and, where one exists, its SQL."""

        def put(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return put


REGISTRY = Registry()
query = REGISTRY.add
