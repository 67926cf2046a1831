"""Names of queries, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with DuckDB SQL for the same rows where SQL can say it."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def load_all() -> None:
    from corpusloom.plans import content, files, graphs, history, recommend, scalars, search, stored, streams, vectors  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_all()
    return QUERIES["hybrid_search"](spark, sf_dir)
