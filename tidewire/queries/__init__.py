"""Registered queries by group; each pairs a DataFrame query with DuckDB SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register the decorated query."""

        def keep(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
