"""Daily series to monthly, climatological, annual and masked tables.

Input is the long form ``(loc, day, value)`` or ``(var, loc, day, value)``.
All reductions are two-phase hash aggregates, so a location with many rows is
combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookcal.session import one_row

# Calibration windows by variable (inclusive dates).
CALIBRATION_WINDOWS = {
    "actual_et": ("2000-01-01", "2010-12-31"),
    "recharge": ("2000-01-01", "2009-12-31"),
    "runoff": ("1982-01-01", "2010-12-31"),
    "soil_moisture": ("1982-01-01", "2010-12-31"),
    "snow_cover": ("2000-01-01", "2010-12-31"),
    "streamflow": ("2000-01-01", "2010-12-31"),
}
SECONDS_PER_DAY = 86400
MISSING = -9999.0


def period_slice(df: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """Rows with start <= day <= end; the literals reach the Parquet scan."""
    return df.where(F.col(day).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def period_slice_by_variable(df: DataFrame, windows: Mapping[str, tuple[str, str]], var: str = "var") -> DataFrame:
    """Each variable keeps its own window; variables without one are dropped."""
    keep = F.lit(False)
    for name, (start, end) in windows.items():
        keep = keep | (
            (F.col(var) == name) & F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
        )
    return df.where(keep)


def keep_locations(df: DataFrame, locations: DataFrame, loc: str = "loc") -> DataFrame:
    """Left-semi join; Catalyst broadcasts the list where its size allows."""
    return df.join(locations.select(loc), loc, "left_semi")


def relabel_segments(df: DataFrame, gauge_map: DataFrame) -> DataFrame:
    """Pick series by 1-based segment index and label them with the gauge id.

    ``df`` has a 0-based ``segment`` column, ``gauge_map`` has
    ``(segment_index, gauge_id)`` with 1-based indices.
    """
    picks = gauge_map.select((F.col("segment_index") - 1).alias("segment"), F.col("gauge_id").alias("loc"))
    return df.join(picks, "segment")


def exclude_months(df: DataFrame, months: Sequence[int] = (7, 8), day: str = "day") -> DataFrame:
    return df.where(~F.month(day).isin(*months))


def derived_sum(df: DataFrame, parts: Sequence[str], target: str) -> DataFrame:
    """Sum of named variables per (loc, day) in one pass over the long table.

    A day that lacks one of the parts gets NULL, as array addition would.
    """
    parts = list(parts)
    total = sum((F.max(F.when(F.col("var") == p, F.col("value"))) for p in parts[1:]),
                F.max(F.when(F.col("var") == parts[0], F.col("value"))))
    return (
        df.where(F.col("var").isin(*parts))
        .groupBy("loc", "day")
        .agg(total.alias("value"))
        .withColumn("var", F.lit(target))
    )


def diagnostic(df: DataFrame, inputs: Mapping[str, str], formula: Callable[..., Column], target: str) -> DataFrame:
    """A user formula over named variables of the same (loc, day).

    ``inputs`` maps argument names to variables; ``formula`` receives one column
    per argument and returns a column, so the result stays inside Catalyst.
    """
    columns = {arg: F.max(F.when(F.col("var") == var, F.col("value"))).alias(f"_{arg}") for arg, var in inputs.items()}
    wide = df.where(F.col("var").isin(*inputs.values())).groupBy("loc", "day").agg(*columns.values())
    value = formula(**{arg: F.col(f"_{arg}") for arg in inputs})
    return wide.select("loc", "day", value.alias("value"), F.lit(target).alias("var"))


def per_second(df: DataFrame, value: str = "value") -> DataFrame:
    """Volume per day to volume per second."""
    return df.withColumn(value, F.col(value) / F.lit(float(SECONDS_PER_DAY)))


def fill_missing(value: Column, sentinel: float = MISSING) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(sentinel))


def drop_sentinel(value: Column, below: float = -999.0) -> Column:
    return F.when(value < below, F.lit(None)).otherwise(value)


def negative_rows(df: DataFrame, value: str = "value") -> DataFrame:
    return df.where(F.col(value) < 0)


def _bin_span(df: DataFrame, unit: str) -> Column:
    span = one_row(df, F.trunc(F.min("day"), unit), F.trunc(F.max("day"), unit))
    step = {"month": F.expr("interval 1 month"), "year": F.expr("interval 1 year")}[unit]
    return F.sequence(span["x0"], span["x1"], step)


def _binned(df: DataFrame, keys: Sequence[str], unit: str, reducer, densify: bool) -> DataFrame:
    keys = list(keys)
    out = df.groupBy(*keys, F.trunc("day", unit).alias("period")).agg(reducer(F.col("value")).alias("value"))
    if densify:
        # resampling keeps one row per bin of the common time axis for every location
        bins = out.select(*keys).distinct().withColumn("period", F.explode(_bin_span(df, unit)))
        out = bins.join(out, [*keys, "period"], "left")
    return out


def monthly_mean(df: DataFrame, keys: Sequence[str] = ("loc",), densify: bool = False) -> DataFrame:
    """Mean of the days of each month; ``densify`` keeps empty months as NULL."""
    return _binned(df, keys, "month", F.avg, densify)


def monthly_sum(df: DataFrame, keys: Sequence[str] = ("loc",)) -> DataFrame:
    return _binned(df, keys, "month", F.sum, False)


def annual_mean(df: DataFrame, keys: Sequence[str] = ("loc",), densify: bool = False) -> DataFrame:
    """Average daily rate per calendar year."""
    return _binned(df, keys, "year", F.avg, densify)


def mean_monthly(df: DataFrame, keys: Sequence[str] = ("loc",)) -> DataFrame:
    """Climatology: mean over the years of the monthly means (not of the days).

    The second aggregate groups on a subset of what the first one produced and
    handles at most twelve rows per location and year.
    """
    return (
        monthly_mean(df, keys)
        .groupBy(*keys, F.month("period").alias("month"))
        .agg(F.avg("value").alias("value"))
    )


def min_max_normalise(df: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """(x - min) / (max - min) over the whole table, or per key."""
    lo, hi = F.min("value"), F.max("value")
    if not per:
        span = one_row(df, lo, hi)
        return df.withColumn("value", (F.col("value") - span["x0"]) / F.try_subtract(span["x1"], span["x0"]))
    spans = df.groupBy(*per).agg(lo.alias("_lo"), hi.alias("_hi"))
    return (
        df.join(spans, list(per))
        .withColumn("value", F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
        .drop("_lo", "_hi")
    )


def snow_cover_bounds(
    df: DataFrame,
    threshold: float = 70.0,
    min_years: int = 1,
    min_peak: float = 0.5,
    min_days: int = 9,
) -> DataFrame:
    """Lower and upper snow-cover targets from extent and clear-sky index.

    Input ``(loc, day, extent, clear_index)``. Locations are kept when more
    than ``min_years`` annual means are positive, the peak exceeds ``min_peak``
    and more than ``min_days`` days have snow. Per-location facts come from one
    (loc, year) aggregate that is folded once more.
    """
    clear = exclude_months(df).select(
        "loc", "day",
        F.when(F.col("clear_index") >= threshold, F.col("clear_index") / 100.0).alias("ci"),
        "extent",
    ).withColumn("sca", F.when(F.col("ci").isNotNull(), F.col("extent")))
    facts = (
        clear.groupBy("loc", F.year("day").alias("_y"))
        .agg(F.avg("sca").alias("_mean"), F.max("sca").alias("_peak"), F.count_if(F.col("sca") > 0).alias("_days"))
        .groupBy("loc")
        .agg(
            F.count_if(F.col("_mean") > 0).alias("_years"),
            F.max("_peak").alias("_peak"),
            F.sum("_days").alias("_days"),
        )
        .where((F.col("_years") > min_years) & (F.col("_peak") > min_peak) & (F.col("_days") > min_days))
        .select("loc")
    )
    return (
        clear.join(facts, "loc", "left_semi")
        .select("loc", "day", (F.col("ci") * F.col("sca")).alias("lower"), "ci")
        .withColumn("upper", F.col("lower") + (F.lit(1.0) - F.col("ci")))
        .drop("ci")
    )
