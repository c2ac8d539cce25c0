"""Every query the library exposes over the given tables, with its DuckDB oracle.

``register`` pairs a name with a function ``(spark, sf_dir) -> DataFrame`` and, where SQL
can say the same, with an ANSI SQL text over the same parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def load() -> None:
    """Import the query sets once; each registers itself."""
    from varve.plans import queries_core, queries_more, queries_quality  # noqa: F401
