"""All queries of the engine's own operators, with the DuckDB SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package; each has QUERIES (name -> function) and SQL (name -> DuckDB text).
MODULES = ("relational", "statistics", "learning", "networks", "models", "sounds", "tensors", "formats", "learners", "numerics")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").SQL
    return found
