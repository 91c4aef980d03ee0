"""Registry of the query functions and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadloom.plans.adapters import SQL, Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of `Tables`. The oracle is SQL over the derived tables: a
    select, or further common table expressions that begin with a comma."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = f"with {SQL.strip()}\n{oracle.strip()}"
        return f

    return put


def _load() -> None:
    from leadloom.plans import aggregates, evaluation, expressions, features, joins, lists, names, storage  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["list_hybrid"](spark, sf_dir)
