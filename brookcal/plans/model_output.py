"""Daily model output to an observation-equivalent table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookcal.functions import names
from brookcal.operators import series
from brookcal.sources.tables import stack


class Target(NamedTuple):
    """One group of observation equivalents.

    ``period`` is ``mon``, ``mean_mon``, ``ann`` or ``daily``; ``normalise``
    scales to the range over all times and locations.
    """

    group: str
    var: str
    period: str
    start: str
    end: str
    normalise: bool = False
    per_second: bool = False
    exclude_months: tuple[int, ...] = ()


def _equivalents(daily: DataFrame, t: Target) -> DataFrame:
    df = series.period_slice(daily.where(F.col("var") == t.var), t.start, t.end)
    if t.exclude_months:
        df = series.exclude_months(df, t.exclude_months)
    if t.per_second:
        df = series.per_second(df)
    if t.period == "daily":
        out, period = df, names.day_period(F.col("day"))
    elif t.period == "mon":
        out, period = series.monthly_mean(df), names.month_period(F.col("period"))
    elif t.period == "mean_mon":
        out, period = series.mean_monthly(df), F.col("month")
    elif t.period == "ann":
        out, period = series.annual_mean(df), F.year("period")
    else:
        raise ValueError(f"unknown period {t.period}")
    if t.normalise:
        out = series.min_max_normalise(out)
    return out.select(
        names.build_name(t.group, period, F.col("loc")).alias("obsnme"), F.col("value").alias("obsval"), F.lit(t.group).alias("obgnme"))


def observation_equivalents(daily: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """All target groups of ``daily(var, loc, day, value)`` as one table, keyed by name."""
    return stack([_equivalents(daily, t) for t in targets])
