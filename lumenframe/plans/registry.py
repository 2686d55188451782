"""How a module of queries keeps them."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name, and the DuckDB SQL of those that SQL expresses."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
