"""Prior variances and reproducible draws, in long form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookcal.functions.draws import standard_normal, triangular, uniform
from brookcal.operators.ensembles import deviations
from brookcal.operators.pairs import block_product
from brookcal.operators.parameters import clip, log_span
from brookcal.session import one_row, spread

MIN_WEIGHT = 1.0e-30
MOST_IN_GROUP = 2048


def observation_variance(obs: DataFrame) -> DataFrame:
    """(name, var): standard_deviation^2 where given, else (1 / max(weight, tiny))^2."""
    from_weight = F.lit(1.0) / F.greatest(F.col("weight"), F.lit(MIN_WEIGHT))
    std = F.coalesce("standard_deviation", from_weight) if "standard_deviation" in obs.columns else from_weight
    return obs.select(F.col("obsnme").alias("name"), (std * std).alias("var"))


def parameter_variance(pars: DataFrame, sigma_range: float = 4.0, scale_offset: bool = True) -> DataFrame:
    """(name, var) of the adjustable parameters in estimation space.

    A given deviation is used as is (log10 space for log parameters), else
    (upper - lower) / sigma_range. ``invalid`` marks missing or zero results.
    """
    p = pars.where(~F.col("partrans").isin("tied", "fixed"))
    if scale_offset:
        p = p.withColumn("parlbnd", F.col("parlbnd") * F.col("scale") + F.col("offset")).withColumn(
            "parubnd", F.col("parubnd") * F.col("scale") + F.col("offset"))
    std = log_span(p) / sigma_range
    if "standard_deviation" in p.columns:
        given = F.when(F.col("partrans") == "log", F.log10("standard_deviation")).otherwise(F.col("standard_deviation"))
        std = F.coalesce(given, std)
    return p.select(F.col("parnme").alias("name"), (std * std).alias("var")).withColumn(
        "invalid", F.col("var").isNull() | F.isnan("var") | (F.col("var") == 0))


def _realizations(df: DataFrame, n: int, name: str = "name") -> DataFrame:
    """One row per (name, realization). The names are dealt out before they are multiplied: a short table may come as one partition,
    and an aggregate by name then finds its rows in place."""
    numbered = spread(df, name).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1))))
    return numbered.withColumn("real", F.col("_i").cast("string")).drop("_i")


def gaussian_draw(table: DataFrame, n: int, seed: int) -> DataFrame:
    """mean + std x N(0, 1) per (realization, name) of ``table(name, mean, std)``."""
    z = standard_normal(seed, F.col("real"), F.col("name"))
    return _realizations(table, n).select("real", "name", (F.col("mean") + F.col("std") * z).alias("value"))


def _log(pars: DataFrame, c: str) -> Column:
    return F.when(F.col("partrans") == "log", F.log10(c)).otherwise(F.col(c))


def _unlog(c: Column) -> Column:
    return F.when(F.col("partrans") == "log", F.pow(F.lit(10.0), c)).otherwise(c)


def parameter_draw(
    pars: DataFrame,
    n: int,
    seed: int,
    how: DataFrame | None = None,
    default: str = "gaussian",
    sigma_range: float = 4.0,
    enforce: bool = True,
) -> DataFrame:
    """Draw every parameter from its own distribution in estimation space.

    ``how(parnme, how)`` names ``gaussian``, ``uniform`` or ``triangular`` per
    parameter; the rest use ``default``. Fixed and tied parameters keep their
    value. Values are back-transformed and clipped to the bounds.
    """
    if default not in ("gaussian", "uniform", "triangular"):
        raise ValueError(f"unknown distribution {default}")
    t = pars.join(how.select("parnme", "how"), "parnme", "left") if how is not None else pars.withColumn("how", F.lit(None).cast("string"))
    t = t.withColumn("how", F.coalesce("how", F.lit(default)))
    # each step is a column of its own: one expression repeats its parts until the JVM no longer compiles its method
    t = t.withColumns({"_lo": _log(t, "parlbnd"), "_mid": _log(t, "parval1"), "_hi": _log(t, "parubnd")})
    lo, mid, hi, u = F.col("_lo"), F.col("_mid"), F.col("_hi"), F.col("_u")
    keys = (F.col("real"), F.col("parnme"))
    drawn = (
        F.when(F.col("how") == "gaussian", mid + (hi - lo) / sigma_range * standard_normal(seed, *keys))
        .when(F.col("how") == "uniform", lo + u * (hi - lo))
        .when(F.col("how") == "triangular", triangular(u, lo, mid, hi))
        .otherwise(F.raise_error(F.lit("unknown distribution")).cast("double"))
    )
    free = _realizations(t, n, "parnme").withColumn("_u", uniform(seed, *keys)).withColumn("_drawn", drawn).withColumn("_free", _unlog(F.col("_drawn")))
    value = F.when(F.col("partrans").isin("tied", "fixed"), F.col("parval1")).otherwise(
        clip(F.col("_free"), F.col("parlbnd"), F.col("parubnd")) if enforce else F.col("_free"))
    return free.select("real", F.col("parnme").alias("name"), value.alias("value"))


def _rng(seed: int, *labels: str) -> np.random.Generator:
    """A generator that depends on the labels only."""
    return np.random.default_rng([seed, *[b for label in labels for b in f"{label}/".encode()]])


def _long(draws: np.ndarray, names: np.ndarray) -> dict[str, np.ndarray]:
    n = len(draws)
    return {"real": np.repeat(np.arange(n).astype(str), len(names)), "name": np.tile(names, n), "dev": draws.ravel()}


def _factor_draw(n: int, seed: int):
    """Draws of one group: eigen factor, so semi-definite covariances are fine."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["row"].to_numpy(dtype=object), pdf["col"].to_numpy(dtype=object)]).astype(str))
        at = {k: i for i, k in enumerate(names)}
        c = np.zeros((len(names), len(names)))
        i, j = pdf["row"].map(at).to_numpy(), pdf["col"].map(at).to_numpy()
        c[i, j] = pdf["v"].to_numpy()
        c[j, i] = pdf["v"].to_numpy()
        w, q = np.linalg.eigh(c)
        z = _rng(seed, str(pdf["group"].iloc[0])).standard_normal((n, len(names)))
        return pd.DataFrame(_long(z @ (q * np.sqrt(np.clip(w, 0.0, None))).T, names.astype(object)))

    return draw


def correlated_draw(cov: DataFrame, means: DataFrame, n: int, seed: int, most: int = MOST_IN_GROUP) -> DataFrame:
    """Draws with the covariance ``cov(group, row, col, v)`` of every group (each pair once); ``means(name, mean)``.

    A group is factored as a whole in one task, so it may have ``most`` names;
    a larger one is an error. ``ensemble_based_draw`` needs no factor and takes
    any number of names.
    """
    named = cov.where(F.col("row") == F.col("col"))
    largest = one_row(named.groupBy("group").agg(F.count(F.lit(1)).alias("_n")), F.max("_n"))["x0"]
    message = F.concat(F.lit("a correlated group has "), largest.cast("string"), F.lit(f" names, more than the {most} one task factors"))
    # tested before any group is gathered
    checked = cov.withColumn("v", F.when(largest > most, F.raise_error(message).cast("double")).otherwise(F.col("v")))
    dev = spread(checked, "group").groupBy("group").applyInPandas(
        _factor_draw(int(n), int(seed)), "real string, name string, dev double")
    return dev.join(means, "name").select("real", "name", (F.col("mean") + F.col("dev")).alias("value"))


def ensemble_based_draw(ens: DataFrame, n: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Draws with the empirical covariance of an ensemble, without any factor.

    mean + sum_k dev_k x z_k / sqrt(n_ens - 1) has exactly that covariance; the
    product runs in blocks, so neither names nor realizations meet in one task.
    """
    size = one_row(ens, F.count_distinct("real"))["x0"]
    old = ens.select(F.col("real").alias("k")).distinct()
    z = _realizations(old, n, "k").select(
        F.col("real").alias("row"), "k", standard_normal(seed, F.col("real"), F.col("k")).alias("v"))
    dev = deviations(ens).select(F.col("real").alias("k"), F.col("name").alias("col"), F.col("value").alias("v"))
    mean = ens.groupBy("name").agg(F.avg("value").alias("_m"))
    return block_product(z, dev, dense=True).select(
        F.col("row").alias("real"), F.col("col").alias("name"), (F.col("v") / F.sqrt(size - 1.0)).alias("_d")
    ).join(mean, "name").select("real", "name", (F.col("_m") + F.col("_d")).alias("value"))


def autocorrelated_covariance(obs: DataFrame, sill: float, reach: float, window: float) -> DataFrame:
    """Covariance table of noise that decays exponentially with time inside each group.

    ``obs(obsnme, obgnme, t, std)``. Pairs further apart than ``window`` are
    beyond the correlation support and are not formed; time is bucketed by the
    window so the join touches neighbouring buckets only.
    """
    b = F.floor(F.col("t") / F.lit(float(window)))
    left = obs.select(F.col("obgnme").alias("group"), F.col("obsnme").alias("row"), F.col("t").alias("_t1"), F.col("std").alias("_s1"), b.alias("_b"))
    right = obs.select(
        F.col("obgnme").alias("group"), F.col("obsnme").alias("col"), F.col("t").alias("_t2"), F.col("std").alias("_s2"),
        F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    h = F.abs(F.col("_t1") - F.col("_t2"))
    return left.join(right, ["group", "_b"]).where((F.col("row") <= F.col("col")) & (h <= window)).select(
        "group", "row", "col", (F.col("_s1") * F.col("_s2") * sill * F.exp(-h / reach)).alias("v"))
