"""One registry of queries: name, Spark function, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLE


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["sliding_windows"](spark, sf_dir)


from motiondeck.plans import cohort, frames, kernels, recovery, relational, windows  # noqa: E402, F401  importing a plan registers its queries
