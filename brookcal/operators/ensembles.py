"""Ensembles in long form ``(real, name, value)``.

(real, name) is unique, so a name holds at most one row per realization. All
aggregates combine map-side; order statistics go through value buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookcal.functions import names as N
from brookcal.functions.order_stats import exact_quantiles
from brookcal.operators.parameters import clip

BASE = "base"
KEYS = ["real", "name"]


def real_order(real: Column) -> list[Column]:
    """Integer ids in numeric order, then text ids, ``base`` last."""
    number = real.try_cast("bigint")
    return [F.when(real == BASE, 2).when(number.isNull(), 1).otherwise(0), number, real]


# arithmetic ---------------------------------------------------------------

_OPS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b), "**": lambda a, b: F.pow(a, b),
}


def _op(symbol: str):
    if symbol not in _OPS:
        raise ValueError(f"unknown operator {symbol}")
    return _OPS[symbol]


def with_scalar(ens: DataFrame, op: str, scalar: float) -> DataFrame:
    return ens.withColumn("value", _op(op)(F.col("value"), F.lit(float(scalar))))


def with_ensemble(left: DataFrame, op: str, right: DataFrame) -> DataFrame:
    """Elementwise, matched by (real, name); cells missing on one side are NULL."""
    r = right.select(*KEYS, F.col("value").alias("_v"))
    return left.join(r, KEYS, "full").select(*KEYS, _op(op)(F.col("value"), F.col("_v")).alias("value"))


def with_row(ens: DataFrame, op: str, row: DataFrame) -> DataFrame:
    """Each realization against one row ``(name, value)``."""
    r = row.select("name", F.col("value").alias("_v"))
    return ens.join(r, "name").select(*KEYS, _op(op)(F.col("value"), F.col("_v")).alias("value"))


# transforms ---------------------------------------------------------------


def _flagged(ens: DataFrame, pars: DataFrame) -> DataFrame:
    return ens.join(pars.select(F.col("parnme").alias("name"), (F.col("partrans") == "log").alias("_log")), "name")


def transform(ens: DataFrame, pars: DataFrame) -> DataFrame:
    """log10 of the log-transformed parameters."""
    return _flagged(ens, pars).select(*KEYS, F.when(F.col("_log"), F.log10("value")).otherwise(F.col("value")).alias("value"))


def back_transform(ens: DataFrame, pars: DataFrame) -> DataFrame:
    return _flagged(ens, pars).select(
        *KEYS, F.when(F.col("_log"), F.pow(F.lit(10.0), F.col("value"))).otherwise(F.col("value")).alias("value"))


def deviations(ens: DataFrame, center_on: str | None = None) -> DataFrame:
    """Value minus the mean of the name, or minus a named realization."""
    if center_on is None:
        center = ens.groupBy("name").agg(F.avg("value").alias("_c"))
    else:
        center = ens.where(F.col("real") == center_on).select("name", F.col("value").alias("_c"))
    return ens.join(center, "name").select(*KEYS, (F.col("value") - F.col("_c")).alias("value"))


# shape --------------------------------------------------------------------


def residuals_from_ensemble(ens: DataFrame, obs: DataFrame) -> DataFrame:
    """``base`` realization if present, else the mean; deviation over realizations; residual against obs."""
    per_name = ens.groupBy("name").agg(
        F.coalesce(F.max(F.when(F.col("real") == BASE, F.col("value"))), F.avg("value")).alias("modelled"),
        F.stddev_samp("value").alias("std"),
    )
    o = obs.select(F.col("obsnme").alias("name"), F.col("obgnme").alias("group"), F.col("obsval").alias("measured"), "weight")
    return o.join(per_name, "name").withColumn("residual", F.col("measured") - F.col("modelled"))


def residual_template(obs: DataFrame) -> DataFrame:
    """Residual-shaped frame of an observation table: modelled equals measured."""
    return obs.select(
        F.col("obsnme").alias("name"), F.col("obgnme").alias("group"), F.col("obsval").alias("measured"),
        F.col("obsval").alias("modelled"), F.lit(0.0).alias("residual"), "weight")


def add_base(ens: DataFrame, control: DataFrame) -> DataFrame:
    """The last realization gives way to the control values under the id ``base``.

    ``control(name, value)``. Raises when ``base`` is already there.
    """
    order = F.struct(*real_order(F.col("real")))
    facts = ens.agg(F.max_by("real", order).alias("last"), F.max(F.col("real") == BASE).alias("has"))
    last = facts.select(
        F.when(F.col("has"), F.raise_error(F.lit("the ensemble already holds a base realization"))).otherwise(F.col("last"))
        .cast("string").alias("last")).scalar()
    base = control.select(F.lit(BASE).alias("real"), "name", "value").join(ens.select("name"), "name", "left_semi")
    return ens.where(F.col("real") != last).select(*KEYS, "value").unionByName(base.select(*KEYS, "value"))


def nonzero_names(ens: DataFrame, obs: DataFrame) -> DataFrame:
    keep = obs.where(F.col("weight") > 0).select(F.col("obsnme").alias("name"))
    return ens.join(keep, "name", "left_semi")


def drop_missing(ens: DataFrame, axis: str = "real") -> DataFrame:
    """Drop realizations (or names) that hold a missing value.

    A cell without a row counts as missing: the number of present values per
    key is compared with the size of the other axis.
    """
    other = "name" if axis == "real" else "real"
    clean = F.col("value").isNotNull() & ~F.isnan("value")
    size = ens.select(other).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    full = ens.groupBy(axis).agg(F.count_if(clean).alias("_n")).where(F.col("_n") == size).select(axis)
    return ens.join(full, axis, "left_semi")


def renumber(survivors: DataFrame) -> DataFrame:
    """(real, new_real): ids 0..n-2 in order, the last one is ``base``.

    The input is a list of realization ids, bounded by the run's ensemble size.
    """
    order = real_order(F.col("real"))
    ids = survivors.select("real").distinct()
    w = Window.orderBy(*order)
    numbered = ids.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return numbered.select(
        "real", F.when(F.col("_i") == F.col("_n") - 1, BASE).otherwise(F.col("_i").cast("string")).alias("new_real"))


def apply_renumber(ens: DataFrame, mapping: DataFrame) -> DataFrame:
    return ens.join(mapping, "real").select(F.col("new_real").alias("real"), "name", "value")


def to_wide(ens: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide form for a small, listed set of names."""
    return ens.groupBy("real").pivot("name", list(names)).agg(F.first("value"))


def sample_realizations(ens: DataFrame, k: int, seed: int) -> DataFrame:
    """k realizations in a reproducible hash order, without replacement."""
    ids = ens.select("real").distinct()
    return ids.orderBy(F.xxhash64(F.lit(int(seed)), "real"), "real").limit(int(k))


def ordered_by_location(ens: DataFrame) -> DataFrame:
    """Adds location and period parts and sorts rows inside each location."""
    parts = N.period_parts(F.col("name"))
    out = ens.withColumn("loc", N.name_location(F.col("name")))
    for k, c in parts.items():
        out = out.withColumn(k, c)
    return out.repartitionByRange("loc", "year", "month", "date").sortWithinPartitions("loc", "year", "month", "date", "name")


# summaries ----------------------------------------------------------------


def envelope(ens: DataFrame, quantiles: bool = True) -> DataFrame:
    """min, max and 5 / 95 % quantiles of each name over the realizations."""
    out = ens.groupBy("name").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    if quantiles:
        out = out.join(exact_quantiles(ens, ["name"], "value", {"q05": 0.05, "q95": 0.95}), "name", "left")
    return out


def parameter_envelope(ens: DataFrame, pars: DataFrame) -> DataFrame:
    p = pars.select(
        F.col("parnme").alias("name"), F.col("parlbnd").alias("low_bound"), F.col("parubnd").alias("upper_bound"),
        F.col("parval1").alias("starting"))
    env = envelope(ens, quantiles=False)
    parts = F.split("name", ":")
    return env.join(p, "name", "left").select(
        "name", F.get(parts, F.lit(0)).alias("pargroup"), F.get(parts, F.lit(1)).alias("location"),
        F.col("min").alias("par_min"), F.col("max").alias("par_max"), "low_bound", "upper_bound", "starting")


def change_summary(first: DataFrame, second: DataFrame, pars: DataFrame | None = None) -> DataFrame:
    """Change of mean and percent change of deviation per name, log parameters in log space."""
    if pars is not None:
        first, second = transform(first, pars), transform(second, pars)
    stats = lambda df, i: df.groupBy("name").agg(
        F.avg("value").alias(f"mean{i}"), F.stddev_samp("value").alias(f"std{i}"))
    return stats(first, 1).join(stats(second, 2), "name").select(
        "name", (F.col("mean1") - F.col("mean2")).alias("mean_change"),
        F.try_divide(100.0 * (F.col("std1") - F.col("std2")), F.col("std1")).alias("std_change"))


def change_histograms(changes: DataFrame, groups: DataFrame, bins: int = 10) -> DataFrame:
    """Histograms of ``change_summary`` by group: ``(group, measure, bin, low, high, n, entries, smallest, largest)``.

    ``groups(name, group, active)``; the group ``all`` holds the active names. ``bins`` bins of equal width, numbered from 1 and
    closed on the left, span the values of a group, the last one is closed on both sides; equal values lie in the middle of a
    span of 1. Missing changes do not count, and every bin of a group with values is a row.
    """
    named = groups.select("name", "group").unionByName(groups.where("active").select("name", F.lit("all").alias("group")))
    long = changes.join(named, "name").unpivot(["name", "group"], ["mean_change", "std_change"], "measure", "v").where(
        F.col("v").isNotNull() & ~F.isnan("v")).withColumn("measure", F.regexp_replace("measure", "_change", ""))
    span = long.groupBy("group", "measure").agg(F.count(F.lit(1)).alias("entries"), F.min("v").alias("smallest"), F.max("v").alias("largest"))
    half = F.when(F.col("smallest") == F.col("largest"), F.lit(0.5)).otherwise(F.lit(0.0))
    span = span.withColumn("_lo", F.col("smallest") - half).withColumn("_w", (F.col("largest") + half - (F.col("smallest") - half)) / bins)
    slot = F.least(F.floor((F.col("v") - F.col("_lo")) / F.col("_w")) + 1, F.lit(bins)).cast("int")
    counts = long.join(span, ["group", "measure"]).groupBy("group", "measure", slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return every.join(counts, ["group", "measure", "bin"], "left").select(
        "group", "measure", "bin", (F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("low"), (F.col("_lo") + F.col("bin") * F.col("_w")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"), "entries", "smallest", "largest")


def variance_reduction(prior: DataFrame, posterior: DataFrame) -> DataFrame:
    var = lambda df, n: df.groupBy("name").agg(F.var_samp("value").alias(n))
    return var(prior, "prior_var").join(var(posterior, "post_var"), "name").withColumn(
        "percent_reduction", 100.0 * (1.0 - F.try_divide(F.col("post_var"), F.col("prior_var"))))


def shared_histogram(ensembles: DataFrame, bins: int = 10) -> DataFrame:
    """Counts per (label, name, bin); the bins of a name span all labelled ensembles.

    ``ensembles(label, real, name, value)``.
    """
    span = ensembles.groupBy("name").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    slot = F.when(F.col("_lo") == F.col("_hi"), F.lit(1)).otherwise(
        F.least(F.width_bucket(F.col("value"), F.col("_lo"), F.col("_hi"), F.lit(bins)), F.lit(bins))).cast("int")
    return ensembles.join(span, "name").groupBy("label", "name", slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def difference_of_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names that only one of two tables holds; empty when they agree."""
    a = left.select("name").distinct().withColumn("_l", F.lit(True))
    b = right.select("name").distinct().withColumn("_r", F.lit(True))
    return a.join(b, "name", "full").where(F.col("_l").isNull() | F.col("_r").isNull()).select(
        "name", F.when(F.col("_l").isNull(), "right").otherwise("left").alias("only_in"))


def run_example(ens: DataFrame, noise: DataFrame, obs: DataFrame) -> DataFrame:
    """Base realization of simulated and measured values with group, weight and deviation."""
    m = ens.where(F.col("real") == BASE).select("name", F.col("value").alias("modelled"))
    z = noise.where(F.col("real") == BASE).select("name", F.col("value").alias("measured"))
    o = obs.select(F.col("obsnme").alias("name"), F.col("obgnme").alias("group"), "weight", "standard_deviation")
    return m.join(z, "name").join(o, "name")


# bounds -------------------------------------------------------------------


def _bounded(ens: DataFrame, pars: DataFrame, tol: float) -> DataFrame:
    p = pars.select(
        F.col("parnme").alias("name"), (F.col("parubnd") * (1.0 - tol)).alias("_ub"),
        (F.col("parlbnd") * (1.0 + tol)).alias("_lb"), F.col("parval1").alias("_base"))
    return ens.join(p, "name")


def enforce_reset(ens: DataFrame, pars: DataFrame, bound_tol: float = 0.0) -> DataFrame:
    return _bounded(ens, pars, bound_tol).select(
        *KEYS, clip(F.col("value"), F.col("_lb"), F.col("_ub")).alias("value"))


def enforce_drop(ens: DataFrame, pars: DataFrame, bound_tol: float = 0.0) -> DataFrame:
    """Drop realizations with any violation."""
    out = (F.col("value") > F.col("_ub")) | (F.col("value") < F.col("_lb"))
    bad = _bounded(ens, pars, bound_tol).where(out).select("real").distinct()
    return ens.join(bad, "real", "left_anti")


def enforce_scale(ens: DataFrame, pars: DataFrame, bound_tol: float = 0.0) -> DataFrame:
    """Shrink a violating realization toward the start values by its smallest ratio.

    Start values at or beyond a bound are an error, as no ratio exists.
    """
    v, b = F.col("value"), F.col("_base")
    t = _bounded(ens, pars, bound_tol)
    over = F.when(v > F.col("_ub"), F.abs(F.col("_ub") - b) / F.abs(v - b)).when(
        v < F.col("_lb"), F.abs(b - F.col("_lb")) / F.abs(v - b))
    stuck = (F.col("_ub") == b) | (F.col("_lb") == b)
    ratio = t.groupBy("real").agg(F.min(over).alias("_f"), F.max(stuck).alias("_stuck")).select(
        "real",
        F.when(F.col("_stuck"), F.raise_error(F.lit("start value at a bound")).cast("double"))
        .otherwise(F.least(F.coalesce("_f", F.lit(1.0)), F.lit(1.0))).alias("_f"))
    return t.join(ratio, "real").select(
        *KEYS, F.when(F.col("_f") < 1.0, b + (v - b) * F.col("_f")).otherwise(v).alias("value"))


# representative realizations and conflict -----------------------------------


def representative_realizations(ens: DataFrame, obs: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """For every quantile the realization closest to the pointwise quantile.

    Distance is the weighted L2 norm over names; ties go to the lowest
    position. Returns ``(label, real, distance)``.
    """
    cols = {f"q{q}": float(q) for q in quantiles}
    points = exact_quantiles(ens, ["name"], "value", cols)
    long = points.select("name", F.explode(F.array(*[
        F.struct(F.lit(k).alias("label"), F.col(f"`{k}`").alias("q")) for k in cols])).alias("p"))
    w = obs.select(F.col("obsnme").alias("name"), "weight")
    dist = (
        ens.join(long.join(w, "name"), "name")
        .groupBy("p.label", "real")
        .agg(F.sqrt(F.sum(F.pow((F.col("value") - F.col("p.q")) * F.col("weight"), F.lit(2.0)))).alias("distance"))
    )
    rank = F.struct("distance", *[c.alias(f"_k{i}") for i, c in enumerate(real_order(F.col("real")))], "real")
    return dist.groupBy("label").agg(F.min(rank).alias("_r")).select("label", "_r.real", "_r.distance")


def quantile_realizations(ens: DataFrame, obs: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """The rows of those realizations, labelled ``q<q>``."""
    chosen = representative_realizations(ens, obs, quantiles).select("label", "real")
    return ens.join(chosen, "real").select(F.col("label").alias("real"), "name", "value")


def conflict_distance(ens: DataFrame, obs: DataFrame, critical: float = 6.34, noise: DataFrame | None = None) -> DataFrame:
    """Names whose (mean - observed)^2 / variance exceeds the critical value.

    ``noise(real, name, value)`` is added to the simulated values if given.
    """
    sim = nonzero_names(ens, obs)
    if noise is not None:
        sim = with_ensemble(sim, "+", noise.join(sim.select("name"), "name", "left_semi"))
    o = obs.select(F.col("obsnme").alias("name"), "obsval")
    d = sim.groupBy("name").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var")).join(o, "name")
    return d.select(
        "name", F.try_divide(F.pow(F.col("mean") - F.col("obsval"), F.lit(2.0)), F.col("var")).alias("sq_distance")
    ).where(F.col("sq_distance") > critical)
