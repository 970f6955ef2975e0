"""Registered queries over the given tables, each with its checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "documents", "provenance", "temporal", "resolution", "graph", "ledger", "scoring", "texts",
    "jobs", "streams", "retrieval", "matching",
)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that must give the same rows."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
