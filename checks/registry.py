"""Registration of queries and the views of the driver's tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Absolute rounding, without negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def sig(col: Column | str) -> Column:
    """Nine significant digits, for values of any magnitude."""
    col = F.col(col) if isinstance(col, str) else col
    return F.format_string("%.8e", col.cast("double")).try_cast("double")


def q_rnd(x: str, digits: int = 6) -> str:
    return f"(round(cast({x} as double), {digits}) + 0.0)"


def q_sig(x: str) -> str:
    return f"cast(printf('%.8e', cast({x} as double)) as double)"
