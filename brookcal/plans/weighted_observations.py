"""Targets and gauge series to a weighted observation table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookcal.functions import names
from brookcal.operators import observations, regime, series
from brookcal.sources.tables import stack


def daily_flow_observations(flow: DataFrame) -> DataFrame:
    """Daily flows named by their class and limb; missing values carry the sentinel."""
    t = regime.classify_flow(flow)
    missing = F.col("discharge").isNull() | (F.col("efc") < 1)
    keep = lambda c: F.when(~missing, F.col(c))
    return t.select(
        names.daily_flow_name(keep("efc"), keep("high_low"), F.col("day"), F.col("loc")).alias("obsnme"),
        series.fill_missing(F.col("discharge")).alias("obsval"))


def range_observations(bounds: DataFrame, group: str) -> DataFrame:
    """Two one-sided observations per ``(period, loc, lo, hi)`` row."""
    sides = F.array(
        F.struct(F.lit(f"l_max_{group}").alias("g"), F.col("hi").alias("v")), F.struct(F.lit(f"g_min_{group}").alias("g"), F.col("lo").alias("v")))
    return bounds.select("period", "loc", F.explode(sides).alias("s")).select(
        names.build_name(F.col("s.g"), F.col("period"), F.col("loc")).alias("obsnme"), series.fill_missing(F.col("s.v")).alias("obsval"))


def weighted_table(parts: list[DataFrame], noise: DataFrame, excluded: DataFrame | None = None, strict_nodata: bool = False) -> DataFrame:
    """Groups, bounds, noise and weights of stacked ``(obsnme, obsval)`` parts."""
    obs = observations.assign_groups(stack(parts), excluded)
    obs = observations.bounds_and_noise(obs, noise)
    return observations.initial_weights(obs, noise, strict_nodata)
