"""Registration of the subpackage's queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "neighbours",
    "simhash",
    "bpe",
    "surrogates",
    "decontaminate",
    "attention",
    "toxicity",
    "token_files",
    "suffix_dedup",
    "licences",
    "periods",
    "conversations",
    "jaccard",
)


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its SQL twin."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def load() -> tuple[dict, dict]:
    """Queries and SQL twins of all operator modules."""
    for name in MODULES:
        import_module(f"{__package__}.{name}")
    return dict(QUERIES), dict(ORACLES)
