"""Registration of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 9) -> DataFrame:
    """Round inexact columns (variances, percentiles) for comparison."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rsql(columns: Sequence[str], digits: int = 9) -> str:
    """The same as a DuckDB REPLACE list."""
    return "* REPLACE (" + ", ".join(f"round({c}, {digits}) AS {c}" for c in columns) + ")"
