"""Registry of the queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.plans.fixtures import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of :class:`Views` under ``name``, with its checking SQL if there is one."""

    def wrap(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
