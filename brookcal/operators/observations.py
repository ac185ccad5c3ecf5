"""Observation tables: groups, bounds, noise and weights as column rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookcal.functions import names
from brookcal.functions.inequality import sense
from brookcal.operators.series import MISSING

# Name prefixes that form groups of their own name.
RANGE_GROUPS = (
    "l_max_actet_mon", "g_min_actet_mon", "l_max_actet_mean_mon", "g_min_actet_mean_mon",
    "l_max_recharge_ann", "g_min_recharge_ann", "l_max_soil_moist_mon", "g_min_soil_moist_mon",
    "l_max_soil_moist_ann", "g_min_soil_moist_ann", "l_max_runoff_mon", "g_min_runoff_mon",
    "l_max_sca_daily", "g_min_sca_daily",
)
FLOW_GROUPS = ("streamflow_mon", "streamflow_mean_mon")
# Flow class and limb of a daily-flow name, and the group it belongs to.
DAILY_FLOW_GROUPS = {
    "1_2": "streamflow_daily_large_asc",
    "1_3": "streamflow_daily_large_dsc",
    "2_2": "streamflow_daily_small_asc",
    "2_3": "streamflow_daily_small_dsc",
    "3_2": "streamflow_daily_pulse_asc",
    "3_3": "streamflow_daily_pulse_dsc",
    "4_1": "streamflow_daily_low",
    "5_1": "streamflow_daily_exlow",
}
NO_DATA_GROUP = "streamflow_nodata"
NO_DATA_STD = 9999.0
SNOW_WEIGHT = 10.0
FLOW_WEIGHT_NUMERATOR = 10.0
LOW_FLOW_WEIGHT = 1.0


def group_of_name(name: Column, default: str = "obgnme") -> Column:
    """Group by the first part of the name; unknown names get ``default``."""
    head = names.name_group(name)
    rule = F.when(head.isin(*RANGE_GROUPS, *FLOW_GROUPS), head)
    for code, group in DAILY_FLOW_GROUPS.items():
        rule = rule.when(head == f"streamflow_daily_{code}", group)
    return rule.when(head == "streamflow_daily_-9999_-9999", NO_DATA_GROUP).otherwise(default)


def assign_groups(obs: DataFrame, excluded_gauges: DataFrame | None = None, default: str = "obgnme") -> DataFrame:
    """Adds ``obgnme``; missing values and excluded gauges of daily flow override the class group.

    ``excluded_gauges`` has one ``loc`` column and is a small list by nature;
    the join side is left to Catalyst's size check.
    """
    daily = F.col("obsnme").startswith("streamflow_daily")
    override = daily & (F.col("obsval") == MISSING)
    out = obs.withColumn("_loc", names.name_location(F.col("obsnme")))
    if excluded_gauges is not None:
        gauges = excluded_gauges.select(F.col("loc").alias("_loc")).distinct().withColumn("_ex", F.lit(True))
        out = out.join(gauges, "_loc", "left")
        override = override | (daily & F.coalesce(F.col("_ex"), F.lit(False)))
    group = F.when(override, NO_DATA_GROUP).otherwise(group_of_name(F.col("obsnme"), default))
    return out.withColumn("obgnme", group).drop("_loc", "_ex")


def bounds_and_noise(obs: DataFrame, noise: DataFrame) -> DataFrame:
    """Adds bounds and the noise deviation of each group's table row.

    The deviation keeps the sign of the observed value, as the rule states.
    """
    table = noise.select(
        F.trim("obsgroup").alias("obgnme"), F.col("noise_percent").cast("double"),
        F.col("obsubnd").cast("double").alias("upper_bound"),
    )
    return obs.join(table, "obgnme", "left").withColumn("lower_bound", F.lit(0.0)).withColumn(
        "standard_deviation",
        F.when(F.col("obsval") == MISSING, F.lit(NO_DATA_STD)).otherwise(F.col("noise_percent") * F.col("obsval")),
    ).drop("noise_percent")


def initial_weights(obs: DataFrame, noise: DataFrame, strict_nodata: bool = False) -> DataFrame:
    """Weights in rule order: the last rule that applies wins.

    An excluded gauge with a value <= 1 ends with weight 1; ``strict_nodata``
    keeps the no-data group at 0 instead.
    """
    table = noise.select(F.trim("obsgroup").alias("obgnme"), F.col("wt_percent").cast("double"))
    group, value = F.col("obgnme"), F.col("obsval")
    flow = group.startswith("streamflow")
    rule = F.when(value == MISSING, F.lit(0.0))
    if strict_nodata:
        rule = rule.when(group == NO_DATA_GROUP, F.lit(0.0))
    rule = (
        rule.when(group.startswith("stream") & (value <= 1), F.lit(LOW_FLOW_WEIGHT))
        .when(group == NO_DATA_GROUP, F.lit(0.0))
        .when(flow, F.try_divide(F.lit(FLOW_WEIGHT_NUMERATOR), value))
        .when(group.isin("l_max_sca_daily", "g_min_sca_daily"), F.lit(SNOW_WEIGHT))
        .otherwise(F.try_divide(F.lit(1.0), F.col("wt_percent")))
    )
    return obs.join(table, "obgnme", "left").withColumn("weight", rule).drop("wt_percent")


def proportional_weights(
    obs: DataFrame, fraction_stdev: float = 1.0, max_weight: float = 100.0, leave_zero: bool = True
) -> DataFrame:
    value = F.col("obsval")
    rule = F.when(value == 0, F.lit(float(max_weight))).otherwise(
        F.least(F.lit(float(max_weight)), F.try_divide(F.lit(1.0), F.abs(value) * fraction_stdev))
    )
    if leave_zero:
        rule = F.when(F.col("weight") == 0, F.lit(0.0)).otherwise(rule)
    return obs.withColumn("weight", rule)


def with_sense(obs: DataFrame) -> DataFrame:
    """Adds ``sense``: one-sided kind by group prefix, ``inactive`` at weight 0."""
    return obs.withColumn("sense", sense(F.col("obgnme"), F.col("weight")))


def nonzero(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("weight") > 0)


def zero_weighted(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("weight") == 0)


def groups(obs: DataFrame, nonzero_only: bool = False, group: str = "obgnme") -> DataFrame:
    return (nonzero(obs) if nonzero_only else obs).select(group).distinct()


def zero_weight_groups(obs: DataFrame) -> DataFrame:
    """Groups without any non-zero weight (set difference of the two group lists)."""
    return (
        obs.groupBy("obgnme").agg(F.count_if(F.col("weight") > 0).alias("_n")).where(F.col("_n") == 0).select("obgnme")
    )


def keep_names(df: DataFrame, listed: DataFrame, name: str = "obsnme") -> DataFrame:
    return df.join(listed.select(name), name, "left_semi")


def subset_run(obs: DataFrame, pars: DataFrame, obs_names: DataFrame, par_names: DataFrame,
               obs_groups: DataFrame, par_groups: DataFrame) -> dict[str, DataFrame]:
    """Keep the listed observations and parameters; the group tables follow."""
    o, p = keep_names(obs, obs_names), keep_names(pars, par_names, "parnme")
    return {
        "observations": o,
        "parameters": p,
        "observation_groups": obs_groups.join(o.select("obgnme"), "obgnme", "left_semi"),
        "parameter_groups": par_groups.join(p.select("pargp"), "pargp", "left_semi"),
    }


def rename(df: DataFrame, mapping: DataFrame, name: str) -> DataFrame:
    """``mapping`` has (old, new); names without an entry stay."""
    m = mapping.select(F.col("old").alias(name), F.col("new").alias("_new"))
    return df.join(m, name, "left").withColumn(name, F.coalesce("_new", name)).drop("_new")


def assign_values(df: DataFrame, values: DataFrame, name: str, column: str) -> DataFrame:
    """Values of ``values(name, column)`` replace the column where the name is listed."""
    v = values.select(name, F.col(column).alias("_v"))
    return df.join(v, name, "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


def set_weight_of_listed_zeros(obs: DataFrame, listed: DataFrame, weight: float) -> DataFrame:
    """Listed names with weight 0 get ``weight``; names match case-insensitively."""
    names_ = listed.select(F.lower("obsnme").alias("_k")).distinct().withColumn("_hit", F.lit(True))
    reset = F.col("_hit").isNotNull() & (F.col("weight") == 0)
    return (
        obs.withColumn("_k", F.lower("obsnme")).join(names_, "_k", "left")
        .withColumn("weight", F.when(reset, F.lit(float(weight))).otherwise(F.col("weight")))
        .drop("_k", "_hit")
    )


def zero_weight_by_range(obs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Weight 0 for observations inside a (location, month range, year range) row.

    ``obs`` carries ``group, loc, year, month``; the range table is keyed by
    ``(group, location)``, so this is an equi join with a residual range test.
    Overlapping ranges collapse in the existence test.
    """
    r = ranges.select(
        F.col("group"), names.pad_id(F.col("location"), 8).alias("loc"),
        "stmonth", "endmonth", "styear", "endyear",
    )
    spans = r.groupBy("group", "loc").agg(F.collect_set(F.struct("stmonth", "endmonth", "styear", "endyear")).alias("_r"))
    inside = F.exists(
        "_r",
        lambda s: F.col("month").between(s["stmonth"], s["endmonth"]) & F.col("year").between(s["styear"], s["endyear"]),
    )
    return obs.join(spans, ["group", "loc"], "left").withColumn(
        "weight", F.when(F.coalesce(inside, F.lit(False)), F.lit(0.0)).otherwise(F.col("weight"))
    ).drop("_r")


def null_checks(obs: DataFrame) -> DataFrame:
    """Per group: rows, NULL weights, rows with any NULL, number of distinct weights."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in obs.columns])
    per_weight = obs.withColumn("_any", any_null).groupBy("obgnme", "weight").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_any").alias("_bad"))
    return per_weight.groupBy("obgnme").agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("weight").isNull(), F.col("_n"))), F.lit(0)).alias("null_weights"),
        F.sum("_bad").alias("rows_with_null"),
        F.count("weight").alias("distinct_weights"),
    )


def summary_table(obs: DataFrame) -> DataFrame:
    """Per group: ranges of value, weight, deviation (1/w) and percent error, weight counts.

    Infinite deviations are missing; a group with any finite value still has a range.
    """
    stdev = F.when(F.col("weight") != 0, F.lit(1.0) / F.col("weight"))
    t = obs.withColumn("stdev", stdev).withColumn(
        "pe", F.when(F.col("obsval") != 0, 100.0 * F.col("stdev") / F.abs("obsval")))
    aggs = [
        F.count_if(F.col("weight") > 0).alias("nonzero_count"),
        F.count_if(F.col("weight") == 0).alias("zero_count"),
    ]
    for c in ("obsval", "weight", "stdev", "pe"):
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return t.groupBy("obgnme").agg(*aggs)


def range_text(lo: Column, hi: Column) -> Column:
    """``min to max`` text, one number when equal, ``NA`` when missing."""
    fmt = lambda c: F.format_string("%.5G", c)
    return F.when(lo.isNull() | hi.isNull(), "NA").when(lo == hi, fmt(lo)).otherwise(
        F.concat(fmt(lo), F.lit(" to "), fmt(hi)))
