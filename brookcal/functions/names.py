"""Composite names ``group:period:location`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_period(day: Column) -> Column:
    """``year_month`` without zero padding."""
    return F.concat(F.year(day), F.lit("_"), F.month(day))


def day_period(day: Column) -> Column:
    """``year_month_day`` without zero padding."""
    return F.concat(F.year(day), F.lit("_"), F.month(day), F.lit("_"), F.day(day))


def build_name(group: Column | str, period: Column, loc: Column) -> Column:
    """``group:period:location``; NULL if any part is missing, since a shorter name would be parsed as another one."""
    group = F.lit(group) if isinstance(group, str) else group
    return F.concat(group, F.lit(":"), period.cast("string"), F.lit(":"), loc.cast("string"))


def pad_id(loc: Column, width: int) -> Column:
    """Zeros in front of ids shorter than ``width``; longer ids stay whole."""
    loc = loc.cast("string")
    return F.when(F.length(loc) < width, F.lpad(loc, width, "0")).otherwise(loc)


def daily_flow_name(flow_class: Column, limb: Column, day: Column, loc: Column) -> Column:
    """Daily-flow names carry the class and limb of the day; -9999 marks none."""
    code = lambda c: F.coalesce(c, F.lit(-9999)).cast("string")
    group = F.concat_ws("_", F.lit("streamflow_daily"), code(flow_class), code(limb))
    return build_name(group, day_period(day), loc)


def name_group(name: Column) -> Column:
    return F.element_at(F.split(name, ":"), 1)


def name_location(name: Column) -> Column:
    return F.element_at(F.split(name, ":"), -1)


def name_period(name: Column) -> Column:
    parts = F.split(name, ":")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1)))


def period_parts(name: Column) -> dict[str, Column]:
    """Year, month and date of a name, decided by its group: ``mean_mon`` holds a
    month, ``_mon`` year and month, ``_ann`` a year, ``daily`` a full date."""
    group, period = name_group(name), name_period(name)
    tokens = F.split(period, "_")
    token = lambda i: F.get(tokens, F.lit(i)).try_cast("int")
    is_clim = group.contains("mean_mon")
    is_mon = ~is_clim & group.endswith("_mon")
    is_ann = group.endswith("_ann")
    is_day = group.contains("daily")
    return {
        "year": F.when(~is_clim & (is_mon | is_ann | is_day), token(0)).cast("int"),
        "month": F.when(is_clim, token(0)).when(is_mon | is_day, token(1)).cast("int"),
        "date": F.when(
            is_day, F.try_to_date(F.format_string("%04d-%02d-%02d", token(0), token(1), token(2)), "yyyy-MM-dd")
        ),
    }


def strip_flow_class(name: Column) -> Column:
    """``streamflow_daily_3_2:...`` becomes ``streamflow_daily:...``."""
    return F.regexp_replace(name, "^streamflow_daily[^:]*", "streamflow_daily")


def metadata_map(name: Column) -> Column:
    """``k:v`` tokens of an underscore-separated name as a map; the last value of a key wins."""
    pairs = F.filter(F.split(name, "_"), lambda t: t.contains(":"))
    entries = F.transform(
        pairs, lambda t: F.struct(F.element_at(F.split(t, ":"), 1).alias("k"), F.element_at(F.split(t, ":"), 2).alias("v"))
    )
    unique = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))),
        lambda e: ~F.exists(
            F.transform(entries, lambda o, j: F.struct(o["k"].alias("k"), j.alias("j"))),
            lambda o: (o["k"] == e["k"]) & (o["j"] > e["i"]),
        ),
    )
    return F.map_from_entries(F.transform(unique, lambda e: F.struct(e["k"], e["v"])))
