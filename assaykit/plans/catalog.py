"""Registry of the named queries and, where SQL can say it, their equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round floating-point results, which differ in the last digits between engines."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def text(values: Column) -> Column:
    """Integer array as text, the same in both engines."""
    return F.array_join(values.cast("array<string>"), ",")
