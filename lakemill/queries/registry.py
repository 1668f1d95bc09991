"""Named queries: a function of (spark, sf_dir), and the same result as SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"query {key} is there already")
            self.queries[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return register
