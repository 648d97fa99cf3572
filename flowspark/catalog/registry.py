"""Registration of the named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its SQL twin."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation cannot show; ``keep`` as is."""
    new = {
        name: F.round(F.col(f"`{name}`"), digits)
        for name, kind in df.dtypes
        if kind in ("double", "float") and name not in keep
    }
    return df.withColumns(new) if new else df
