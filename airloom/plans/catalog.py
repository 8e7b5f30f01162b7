"""Registry of runnable queries with the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def near(c, digits: int = 6):
    """Rounded for comparison. The offset moves exact halves off the rounding boundary, where two engines that sum in
    different orders could fall on different sides."""
    from pyspark.sql import functions as F

    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)
