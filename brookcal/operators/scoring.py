"""Objective function, fit metrics, reweighting and rejection.

Residual tables are ``(name, group, measured, modelled, weight)``. Group tables
derived here hold one row per observation group, far below the row count; the
join back to the rows is left to Catalyst, which broadcasts by measured size.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from brookcal.functions import metrics as M
from brookcal.functions.inequality import one_sided_equation_residual, one_sided_residual
from brookcal.functions.order_stats import exact_quantiles
from brookcal.session import one_row

TOTAL = "total"


def _all_groups() -> WindowSpec:
    """Window for tables of one row per group only: the rows behind them are read once."""
    return Window.partitionBy(F.lit(0))


def contribution() -> Column:
    """(residual x weight)^2 with honoured bounds at 0."""
    swr = one_sided_residual(F.col("group"), F.col("measured"), F.col("modelled")) * F.col("weight")
    return swr * swr


def phi_components(res: DataFrame) -> DataFrame:
    return res.groupBy("group").agg(F.sum(contribution()).alias("phi"))


def phi_with_total(res: DataFrame) -> DataFrame:
    """Components plus a ``total`` row."""
    return (
        res.rollup("group").agg(F.sum(contribution()).alias("phi"), F.grouping("group").alias("_t"))
        .select(F.when(F.col("_t") == 1, TOTAL).otherwise(F.col("group")).alias("group"), "phi")
    )


def phi_normalised(res: DataFrame) -> DataFrame:
    """Component / total; the window runs over one row per group."""
    return phi_components(res).withColumn("share", F.try_divide(F.col("phi"), F.sum("phi").over(_all_groups())))


def equation_phi(eq: DataFrame) -> DataFrame:
    """Components of equation rows ``(name, group, residual, weight)``."""
    r = one_sided_equation_residual(F.col("group"), F.col("residual")) * F.col("weight")
    return eq.groupBy("group").agg(F.sum(r * r).alias("phi"))


def reweight_groups(res: DataFrame, targets: DataFrame) -> DataFrame:
    """Scale the weights of each listed group so that it contributes ``target``.

    Target 0 zeroes the group; an all-zero group restarts from weight 1; a
    group without contribution and unlisted groups stay as they are. Both
    candidate contributions (current weights and all ones) come from one pass.
    """
    resid = one_sided_residual(F.col("group"), F.col("measured"), F.col("modelled"))
    facts = res.groupBy("group").agg(
        F.sum("weight").alias("_w"),
        F.sum(contribution()).alias("_phi"),
        F.sum(resid * resid).alias("_phi1"),
    )
    plan = facts.join(targets.select("group", "target"), "group").select(
        "group",
        (F.col("_w") == 0).alias("_restart"),
        F.when(F.col("target") == 0, F.lit(0.0))
        .otherwise(
            F.coalesce(
                F.sqrt(F.try_divide(F.col("target"), F.nullif(F.when(F.col("_w") == 0, F.col("_phi1")).otherwise(F.col("_phi")), F.lit(0.0)))),
                F.lit(1.0),
            )
        ).alias("_mult"),
    )
    base = F.when(F.col("_restart"), F.lit(1.0)).otherwise(F.col("weight"))
    return (
        res.join(plan, "group", "left")
        .withColumn("weight", F.when(F.col("_mult").isNull(), F.col("weight")).otherwise(base * F.col("_mult")))
        .drop("_restart", "_mult")
    )


def reweight_observations(res: DataFrame, targets: DataFrame) -> DataFrame:
    """Per-observation variant: ``targets(name, target)``; zero weights restart from 1."""
    resid = one_sided_residual(F.col("group"), F.col("measured"), F.col("modelled"))
    base = F.when(F.col("weight") == 0, F.lit(1.0)).otherwise(F.col("weight"))
    phi = F.pow(resid * base, F.lit(2.0))
    scaled = base * F.coalesce(F.sqrt(F.try_divide(F.col("_t"), F.nullif(phi, F.lit(0.0)))), F.lit(1.0))
    t = targets.select("name", F.col("target").alias("_t"))
    return (
        res.join(t, "name", "left")
        .withColumn("weight", F.when(F.col("_t").isNull(), F.col("weight")).otherwise(scaled))
        .drop("_t")
    )


def _is_low(group: Column) -> Column:
    g = F.lower(group)
    return g.contains("exlow") | g.contains("daily_low")


def target_contributions(
    res: DataFrame,
    fractions: DataFrame,
    daily_share: float = 0.2,
    low_share: float = 0.6,
    daily_prefix: str = "streamflow_daily",
) -> DataFrame:
    """Target phi per group: fixed fractions, plus the daily-flow share prorated
    by current contribution inside its low and high classes.

    Also returns ``fraction_sum`` (fractions over phi), which must be 1.
    """
    comps = phi_components(res).withColumn("_daily", F.lower("group").startswith(daily_prefix))
    comps = comps.withColumn("_low", _is_low(F.col("group")))
    comps = comps.withColumns({
        "_all": F.sum("phi").over(_all_groups()),
        "_class": F.sum("phi").over(Window.partitionBy("_daily", "_low")),
    })
    class_share = F.when(F.col("_low"), F.lit(low_share)).otherwise(F.lit(1.0 - low_share))
    prorated = F.try_divide(F.col("phi"), F.col("_class")) * class_share * daily_share
    out = comps.join(fractions.select("group", "fraction"), "group", "left").select(
        "group", "phi",
        F.when(F.col("_daily"), prorated).otherwise(F.col("fraction")).alias("fraction"), "_all",
    ).where(F.col("fraction").isNotNull())
    return out.withColumn("target", F.col("fraction") * F.col("_all")).withColumn(
        "fraction_sum", F.sum("fraction").over(_all_groups())).drop("_all")


def daily_flow_classes(res: DataFrame, daily_prefix: str = "streamflow_daily") -> DataFrame:
    """Count and contribution of daily-flow groups by low / high class."""
    kind = F.when(_is_low(F.col("group")), "low").otherwise("high")
    return (
        res.where(F.lower("group").startswith(daily_prefix))
        .groupBy(kind.alias("class"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(contribution()).alias("phi"))
    )


def discrepancy_weights(res: DataFrame, original_ceiling: bool = True, by_groups: bool = False) -> DataFrame:
    """Scale weights so that each non-zero observation (or group of n) contributes 1 (or n)."""
    if not by_groups:
        swr = contribution()
        factor = F.sqrt(F.try_divide(F.lit(1.0), swr))
        if original_ceiling:
            factor = F.when(swr == 0, F.lit(1.0)).otherwise(F.least(factor, F.lit(1.0)))
        else:
            factor = F.when(swr == 0, F.lit(float("inf"))).otherwise(factor)
        return res.withColumn(
            "weight", F.when(F.col("weight") > 0, F.col("weight") * factor).otherwise(F.col("weight"))
        )
    facts = res.groupBy("group").agg(
        F.sum(contribution()).alias("_phi"), F.count_if(F.col("weight") != 0).alias("_nz"))
    factor = F.sqrt(F.try_divide(F.col("_nz").cast("double"), F.col("_phi")))
    if original_ceiling:
        factor = F.least(factor, F.lit(1.0))
    factor = F.when(F.col("_phi") > 0, factor).otherwise(F.lit(1.0))
    plan = facts.select(
        "group",
        F.when((F.col("_nz") == 0) & (F.col("_phi") > 0), F.raise_error(F.lit("group has phi but no non-zero weight")))
        .otherwise(factor).cast("double").alias("_f"),
    )
    return res.join(plan, "group").withColumn("weight", F.col("weight") * F.col("_f")).drop("_f")


def residual_statistics(res: DataFrame, nonzero: bool = True) -> DataFrame:
    """rss, mean, mae, rmse, nrmse of modelled - measured: a ``total`` row and one per group."""
    rows = res.where(F.col("weight") > 0) if nonzero else res
    r = F.col("modelled") - F.col("measured")
    return (
        rows.rollup("group")
        .agg(
            F.grouping("group").alias("_t"),
            F.sum((r * F.col("weight")) * (r * F.col("weight"))).alias("rss"),
            F.avg(r).alias("mean"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"),
            (F.max("measured") - F.min("measured")).alias("_range"),
        )
        .withColumn("nrmse", F.try_divide(F.col("rmse"), F.col("_range")))
        .withColumn("group", F.when(F.col("_t") == 1, TOTAL).otherwise(F.col("group")))
        .drop("_t", "_range")
    )


def fit_metrics(
    res: DataFrame,
    metrics: str | Iterable[str] = "all",
    keys: Iterable[str] = (),
    by_groups: bool = True,
    drop_zero_weight: bool = True,
    compat: bool = False,
) -> DataFrame:
    """The chosen metrics per (keys, group) plus (keys, ``total``).

    Totals come from grouping sets for the moments. Quartiles use bucketed
    order statistics, once per group and once over all, so the total never
    gathers the table in one task. ``compat`` swaps observed and modelled
    variance in nse / nnse.
    """
    wanted = M.resolve(metrics)
    keys = list(keys)
    rows = res.where(F.col("weight") != 0) if drop_zero_weight else res
    sets = [[*keys]] + ([[*keys, "group"]] if by_groups else [])
    if by_groups:
        grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys, "group").agg(
            F.grouping("group").alias("_t"), *M.moment_aggregates())
    else:
        grouped = rows.groupBy(*keys, F.lit(TOTAL).alias("group")).agg(
            F.lit(1).alias("_t"), *M.moment_aggregates())
    moments = grouped.withColumn("group", F.when(F.col("_t") == 1, TOTAL).otherwise(F.col("group"))).drop("_t")
    if M.NEEDS_QUARTILES & set(wanted):
        labels = [F.lit(TOTAL)] + ([F.col("group")] if by_groups else [])
        spread = rows.select(*keys, F.explode(F.array(*labels)).alias("group"), "measured")
        quart = exact_quantiles(spread, [*keys, "group"], "measured", {"q25": 0.25, "q75": 0.75})
        moments = moments.join(quart, [*keys, "group"], "left")
    return moments.select(*keys, "group", *[M.METRICS[m](compat).alias(m) for m in wanted])


def ensemble_residuals(ens: DataFrame, obs: DataFrame) -> DataFrame:
    """(real, name, group, measured, modelled, weight) of every realization."""
    o = obs.select(
        F.col("obsnme").alias("name"), F.col("obgnme").alias("group"), F.col("obsval").alias("measured"), "weight")
    return ens.withColumnRenamed("value", "modelled").join(o, "name")


def ensemble_fit_metrics(
    ens: DataFrame,
    obs: DataFrame,
    metrics: str | Iterable[str] = "all",
    by_groups: bool = True,
    realizations: DataFrame | None = None,
    drop_zero_weight: bool = True,
    compat: bool = False,
) -> DataFrame:
    """The chosen metrics per realization and group.

    The observed values are the same for every realization, so their quartiles
    are taken once per group from the observation table, not per realization.
    """
    wanted = M.resolve(metrics)
    if realizations is not None:
        ens = ens.join(realizations.select("real"), "real", "left_semi")
    if drop_zero_weight:
        obs = obs.where(F.col("weight") != 0)
    res = ensemble_residuals(ens, obs)
    sets = [[F.col("real")]] + ([[F.col("real"), F.col("group")]] if by_groups else [])
    if by_groups:
        grouped = res.groupingSets(sets, "real", "group").agg(F.grouping("group").alias("_t"), *M.moment_aggregates())
        grouped = grouped.withColumn("group", F.when(F.col("_t") == 1, TOTAL).otherwise(F.col("group"))).drop("_t")
    else:
        grouped = res.groupBy("real", F.lit(TOTAL).alias("group")).agg(*M.moment_aggregates())
    if M.NEEDS_QUARTILES & set(wanted):
        labels = [F.lit(TOTAL)] + ([F.col("obgnme")] if by_groups else [])
        spread = obs.select(F.explode(F.array(*labels)).alias("group"), "obsval")
        quart = exact_quantiles(spread, ["group"], "obsval", {"q25": 0.25, "q75": 0.75})
        grouped = grouped.join(quart, "group", "left")
    return grouped.select("real", "group", *[M.METRICS[m](compat).alias(m) for m in wanted])


def merge_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two count tables side by side; a key that only one of them has keeps NULL in the other's columns. Keys are distinct in each."""
    clash = set(left.columns) & set(right.columns) - {key}
    if clash:
        raise ValueError(f"both count tables have {sorted(clash)}")
    return left.join(right, key, "full")


def conflict_summary(obs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Non-zero groups with their counts, full-outer with the conflict counts of any group."""
    counts = (
        obs.groupBy("obgnme")
        .agg(F.count(F.lit(1)).alias("obs_counts"), F.count_if(F.col("weight") > 0).alias("_nz"))
        .where(F.col("_nz") > 0).drop("_nz")
    )
    hits = (
        conflicts.select(F.col("name").alias("obsnme")).join(obs.select("obsnme", "obgnme"), "obsnme")
        .groupBy("obgnme").agg(F.count(F.lit(1)).alias("pdc_counts"))
    )
    share = F.col("pdc_counts") / F.col("obs_counts")
    return (
        merge_counts(counts, hits, "obgnme")
        .withColumn("fraction", share)
        .withColumn("group_percent_pdc", F.when(share.isNotNull(), F.format_string("%.2f%%", share * 100.0)).otherwise("nan%"))
    )


def conflict_percent(obs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Share of non-zero observations that are in conflict, in percent (one row)."""
    n = one_row(conflicts, F.count(F.lit(1)))
    return obs.agg(F.count_if(F.col("weight") > 0).alias("nonzero_obs")).withColumn(
        "percent", F.try_divide(n["x0"] * 100.0, F.col("nonzero_obs")))


def phi_vector(ens: DataFrame, obs: DataFrame, honour_inequalities: bool = False) -> DataFrame:
    """Weighted sum of squares per realization, plain by default."""
    o = obs.where(F.col("weight") > 0)
    res = ensemble_residuals(ens, o)
    plain = F.pow((F.col("modelled") - F.col("measured")) * F.col("weight"), F.lit(2.0))
    return res.groupBy("real").agg(F.sum(contribution() if honour_inequalities else plain).alias("phi"))


def reject_by_phi(phi: DataFrame, cutoffs: DataFrame, keys: Iterable[str] = ("run",)) -> DataFrame:
    """Realizations (``base`` included) at or below the cutoff of their run."""
    keys = list(keys)
    return phi.join(cutoffs.select(*keys, "cutoff"), keys).where(F.col("phi") <= F.col("cutoff")).drop("cutoff")


def phi_histogram(phi: DataFrame, bins: int = 50, keys: Iterable[str] = ()) -> DataFrame:
    """Equal-width bins between the extremes; the maximum falls in the last bin."""
    keys = list(keys)
    span = one_row(phi, F.min("phi"), F.max("phi"))
    lo, hi = span["x0"], span["x1"]
    slot = F.least(F.width_bucket(F.col("phi"), lo, hi, F.lit(bins)), F.lit(bins))
    bin_no = F.when(lo == hi, F.lit(1)).otherwise(slot).cast("int")
    return phi.groupBy(*keys, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_phi_history(history: DataFrame) -> DataFrame:
    return history.withColumn("log_phi", F.log10("phi"))


def compare_runs(res: DataFrame, other: DataFrame) -> DataFrame:
    """Residual rows joined with another run's values by name."""
    return res.join(other.select("name", F.col("value").alias("alternative")), "name")


def one_to_one(res: DataFrame, keep_zero_weight: bool = False) -> DataFrame:
    """Observed / simulated pairs with residual simulated - observed and group axis limits."""
    rows = res if keep_zero_weight else res.where(F.col("weight") > 0)
    limits = rows.groupBy("group").agg(
        (F.least(F.min("measured"), F.min("modelled")) * 0.9).alias("axis_min"),
        (F.greatest(F.max("measured"), F.max("modelled")) * 1.1).alias("axis_max"),
    )
    return rows.select(
        "name", "group", "measured", "modelled", (F.col("modelled") - F.col("measured")).alias("res")
    ).join(limits, "group")


def targets_from(mapping: Mapping[str, float], spark) -> DataFrame:
    """A small (group, target) table from configuration."""
    return spark.createDataFrame([(k, float(v)) for k, v in mapping.items()], "group string, target double")

