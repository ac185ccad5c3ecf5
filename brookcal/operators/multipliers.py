"""Multiplier tables, time differences and cleaned simulator tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookcal.functions.order_stats import exact_quantiles
from brookcal.functions.ordering import lead_in_group


def _is_product(op: Column) -> Column:
    return op.eqNullSafe("*") | F.lower(op).startswith("m")


def _is_sum(op: Column) -> Column:
    return op.eqNullSafe("+") | F.lower(op).startswith("a")


def apply_multipliers(
    original: DataFrame, steps: DataFrame, keys: Sequence[str], bounds: DataFrame | None = None,
    bound_keys: Sequence[str] = ("model_file",),
) -> DataFrame:
    """Fold the ordered multiplier steps of each key into the original value, then clip.

    ``original(*keys, value)``, ``steps(*keys, ord, op, m)``, ``bounds(*bound_keys, lb, ub)``.
    A key holds one entry per multiplier file; rows without a step stay as they
    are. Unknown operators and differing bounds raise.
    """
    keys = list(keys)
    fold = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "op", "m"))).alias("_s"))
    applied = F.aggregate(
        F.coalesce("_s", F.array().cast(fold.schema["_s"].dataType)),
        F.col("value").cast("double"),
        lambda acc, s: F.when(_is_product(s["op"]), acc * s["m"]).when(_is_sum(s["op"]), acc + s["m"]).otherwise(
            F.raise_error(F.lit("unknown multiplier operator")).cast("double")),
    )
    out = original.join(fold, keys, "left").withColumn("value", applied).drop("_s")
    if bounds is None:
        return out
    b = bounds.groupBy(*bound_keys).agg(
        F.max("ub").alias("_ub"), F.min("ub").alias("_ub0"), F.min("lb").alias("_lb"), F.max("lb").alias("_lb1"))
    b = b.select(
        *bound_keys, "_lb",
        F.when((F.col("_ub") != F.col("_ub0")) | (F.col("_lb") != F.col("_lb1")),
               F.raise_error(F.lit("different bounds for one model file")).cast("double")).otherwise(F.col("_ub")).alias("_ub"))
    v = F.col("value")
    capped = F.when(v > F.col("_ub"), F.col("_ub")).otherwise(v)
    return (
        out.join(b, list(bound_keys), "left")
        .withColumn("value", F.when(capped < F.col("_lb"), F.col("_lb")).otherwise(capped)).drop("_lb", "_ub")
    )


def matched_keys(original: DataFrame, steps: DataFrame, keys: Sequence[str], expected: DataFrame) -> DataFrame:
    """Keys common to both tables per (model_file, ord) against the expected count."""
    found = (
        steps.select(*keys, "ord").distinct().join(original.select(*keys).distinct(), list(keys), "left_semi")
        .groupBy("model_file", "ord").agg(F.count(F.lit(1)).alias("n_common"))
    )
    return expected.join(found, ["model_file", "ord"], "left").select(
        "model_file", "ord", "expected", F.coalesce("n_common", F.lit(0)).alias("n_common"),
        (F.coalesce("n_common", F.lit(0)) == F.col("expected")).alias("ok"))


def reindexed_multipliers(
    original: DataFrame, multipliers: DataFrame, columns: Sequence[str], constants: DataFrame | None = None
) -> DataFrame:
    """Cell-key multiplier: ``original(file, k, i, j, ...)`` is 1-based, the multiplier 0-based.

    Shared value columns are multiplied; a cell without a multiplier becomes
    NULL. ``constants(file, col, val)`` then multiply whole columns of a file.
    """
    m = multipliers.select(
        (F.col("k") + 1).alias("k"), (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"),
        *[F.col(c).alias(f"_m_{c}") for c in columns])
    out = original.join(m, ["k", "i", "j"], "left")
    for c in columns:
        out = out.withColumn(c, F.col(c) * F.col(f"_m_{c}")).drop(f"_m_{c}")
    if constants is None:
        return out
    # one value per column and file; repeated entries multiply
    per_file = constants.groupBy("file").agg(*[
        F.coalesce(F.product(F.when(F.col("col") == c, F.col("val"))), F.lit(1.0)).alias(f"_k_{c}") for c in columns])
    out = out.join(per_file, "file", "left")
    for c in columns:
        out = out.withColumn(c, F.col(c) * F.coalesce(f"_k_{c}", F.lit(1.0))).drop(f"_k_{c}")
    return out


def barrier_multipliers(barriers: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Barrier conductivity times its multiplier, matched on the full five-part key; without one it stays as it is."""
    key = ["lay", "irow1", "icol1", "irow2", "icol2"]
    return barriers.join(multipliers.select(*key, F.col("hydchr").alias("_m")), key, "left").withColumn(
        "hydchr", F.col("hydchr") * F.coalesce("_m", F.lit(1.0))).drop("_m")


def period_multipliers(segments: DataFrame, multipliers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Segment values times the multiplier of their stress period; other periods stay."""
    m = multipliers.select("kper", *[F.col(c).alias(f"_m_{c}") for c in columns])
    out = segments.join(m, "kper", "left")
    for c in columns:
        out = out.withColumn(c, F.col(c) * F.coalesce(f"_m_{c}", F.lit(1.0))).drop(f"_m_{c}")
    return out


def segment_group_sums(flows: DataFrame, segment_map: DataFrame) -> DataFrame:
    """Sum of ``flaqx`` and ``flout`` per stress period and observation base."""
    return flows.join(segment_map, "segment").groupBy("kper", "obs_base").agg(
        F.sum("flaqx").alias("flaqx"), F.sum("flout").alias("flout"))


def listed_reaches(flows: DataFrame, reaches: DataFrame) -> DataFrame:
    """Rows of the listed (segment, reach) pairs with their observation base."""
    return flows.join(reaches, ["segment", "reach"]).select("kper", "obs_base", "flaqx", "flout")


ABSOLUTE_TOLERANCE = 1e-8
RELATIVE_TOLERANCE = 1e-5
_KNEE = ABSOLUTE_TOLERANCE / RELATIVE_TOLERANCE
_WIDTH = 4.0 * RELATIVE_TOLERANCE


def _time_bucket(t: Column) -> Column:
    """Buckets wide enough that close values share one or sit in neighbouring ones."""
    return F.floor(F.signum(t) * F.log1p(F.abs(t) / F.lit(_KNEE)) / F.lit(_WIDTH))


def near_times(df: DataFrame, times: DataFrame, column: str = "time") -> DataFrame:
    """Rows whose time is close to any listed one: |x - t| <= 1e-8 + 1e-5 |t|."""
    b = _time_bucket(F.col("_t"))
    listed = times.select(F.col(column).cast("double").alias("_t")).distinct().select(
        "_t", F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    rows = df.withColumn("_b", _time_bucket(F.col(column)))
    near = F.abs(F.col(column) - F.col("_t")) <= F.lit(ABSOLUTE_TOLERANCE) + F.lit(RELATIVE_TOLERANCE) * F.abs("_t")
    return rows.join(listed, (rows["_b"] == listed["_b"]) & near, "left_semi").drop("_b")


def site_series(cells: DataFrame, sites: DataFrame, inactive: float, fill: float | None = None) -> DataFrame:
    """Time series of each site's cell; inactive times take the layer below.

    ``cells(k, i, j, time, value)``, ``sites(site, k, i, j)``. One pass over the
    cell table: each site asks for both layers and the pair is folded per time.
    """
    close = F.abs(F.col("value") - F.lit(float(inactive))) <= F.lit(ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * abs(inactive))
    asked = sites.select(
        "site", "i", "j", F.explode(F.array(
            F.struct(F.col("k").alias("k"), F.lit(0).alias("below")),
            F.struct((F.col("k") + 1).alias("k"), F.lit(1).alias("below")))).alias("_w")
    ).select("site", "i", "j", "_w.k", "_w.below")
    both = cells.join(asked, ["k", "i", "j"]).groupBy("site", "time").agg(
        F.max(F.when(F.col("below") == 0, F.struct(close.alias("off"), F.col("value").alias("v")))).alias("own"),
        F.max(F.when(F.col("below") == 1, F.col("value"))).alias("lower"),
    )
    value = F.when(F.col("own.off"), F.col("lower")).otherwise(F.col("own.v"))
    if fill is not None:
        value = F.coalesce(value, F.lit(float(fill)))
    return both.where(F.col("own").isNotNull()).select("site", "time", value.alias("value"))


def clean_mixed(df: DataFrame, columns: Sequence[str], times: DataFrame | None = None, column: str = "time") -> DataFrame:
    """Text to numbers: unreadable 0, below 1e-30 (negatives too) 0, above 1e30 capped."""
    out = df
    for c in columns:
        v = F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
        out = out.withColumn(c, F.when(v < 1e-30, 0.0).when(v > 1e30, 1e30).otherwise(v))
    return out if times is None else out.join(times.select(column), column, "left_semi")


def clip_magnitude(value: Column, limit: float) -> Column:
    """Missing becomes 0, large magnitudes are cut to the limit."""
    top = abs(float(limit))
    v = F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))
    return F.greatest(F.least(v, F.lit(top)), F.lit(-top))


# Statistics of a model array: name -> aggregate of (value, lower bound, upper bound).
STATISTICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "mean": lambda v, lb, ub: F.avg(v),
    "stdev": lambda v, lb, ub: F.stddev_pop(v),
    "min": lambda v, lb, ub: F.min(v),
    "max": lambda v, lb, ub: F.max(v),
    "upper_bound": lambda v, lb, ub: F.count_if(v == ub),
    "lower_bound": lambda v, lb, ub: F.count_if(v == lb),
}
ARRAY_QUANTILES = {"quantile_05": 0.05, "quantile_25": 0.25, "median": 0.5, "quantile_75": 0.75, "quantile_95": 0.95}


def array_summary(
    cells: DataFrame, bounds: DataFrame | None = None, zone: str | None = None,
    statistics: Sequence[str] | None = None,
) -> DataFrame:
    """Statistics of new, original and original - new values per model file.

    ``cells(model_file, new, org[, zone])``; zone 0 is masked. ``statistics``
    picks registered names (all by default), unknown ones raise. Quantiles go
    through value buckets, so a large model file is not gathered in one task.
    """
    known = [*STATISTICS, *ARRAY_QUANTILES]
    wanted = list(known if statistics is None else statistics)
    unknown = [s for s in wanted if s not in known]
    if unknown:
        raise ValueError("unknown statistics: " + ", ".join(unknown))
    t = cells if zone is None else cells.where(F.col(zone) != 0)
    if bounds is None:
        t = t.withColumn("lb", F.lit(None).cast("double")).withColumn("ub", F.lit(None).cast("double"))
    else:
        t = t.join(bounds.groupBy("model_file").agg(F.max("ub").alias("ub"), F.min("lb").alias("lb")), "model_file", "left")
    sides = (("new", ""), ("org", "_org"))
    aggs = [
        STATISTICS[s](F.col(c), F.col("lb"), F.col("ub")).alias(f"{s}{suffix}")
        for c, suffix in sides for s in wanted if s in STATISTICS
    ]
    out = t.groupBy("model_file").agg(F.count(F.lit(1)).alias("n"), *aggs)
    probs = {s: ARRAY_QUANTILES[s] for s in wanted if s in ARRAY_QUANTILES}
    if probs:
        for c, suffix in sides:
            q = exact_quantiles(t, ["model_file"], c, {f"{k}{suffix}": p for k, p in probs.items()})
            out = out.join(q, "model_file", "left")
    return out.select("*", *[(F.col(f"{s}_org") - F.col(s)).alias(f"{s}_dif") for s in wanted])


def time_differences(obs: DataFrame, prefix: str = "dif", include_zero_weight: bool = False) -> DataFrame:
    """Consecutive pairs (by name) of the positively weighted observations of each group.

    Value first - second, weight 1 / sqrt(s1^2 + s2^2) with s = 1 / weight. With ``include_zero_weight`` observations without
    weight take part as well; a pair that holds one has weight 0.
    """
    taken = obs if include_zero_weight else obs.where(F.col("weight") > 0)
    rows = taken.select("obsnme", "obgnme", "obsval", "weight")
    t = lead_in_group(rows, "obgnme", "obsnme", ["obsnme", "obsval", "weight"]).where(F.col("next_obsnme").isNotNull())
    square = lambda c: F.pow(F.lit(1.0) / F.col(c), F.lit(2.0))
    both = (F.col("weight") > 0) & (F.col("next_weight") > 0)
    return t.select(
        F.concat(F.lit(f"{prefix}_"), "obsnme", F.lit("__"), "next_obsnme").alias("obsnme"),
        F.concat(F.lit(f"{prefix}_"), "obgnme").alias("obgnme"),
        F.col("obsnme").alias("diff1"), F.col("next_obsnme").alias("diff2"),
        (F.col("obsval") - F.col("next_obsval")).alias("diff_obsval"),
        F.when(both, F.lit(1.0) / F.sqrt(square("weight") + square("next_weight"))).otherwise(F.lit(0.0)).alias("weight"))


def apply_time_differences(config: DataFrame, simulated: DataFrame) -> DataFrame:
    """Differences of simulated values for configured pairs; pairs with an absent name are kept as NULL."""
    a = simulated.select(F.col("name").alias("diff1"), F.col("value").alias("diff1_obsval"))
    b = simulated.select(F.col("name").alias("diff2"), F.col("value").alias("diff2_obsval"))
    return config.select("obsnme", "diff1", "diff2").join(a, "diff1", "left").join(b, "diff2", "left").withColumn(
        "diff_obsval", F.col("diff1_obsval") - F.col("diff2_obsval"))
