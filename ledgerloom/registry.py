"""The catalogue of named queries: a function of (spark, sf_dir), and DuckDB SQL with the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its own name, with its SQL twin."""

    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from .plans import ask, evaluating, fields, invoices, layouts, operations, retrieving, scalars, state, streams, texts  # noqa: F401
