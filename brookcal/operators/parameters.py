"""Parameter tables: expansion, bounds, transforms, limits, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookcal.functions.ordering import global_row_number
from brookcal.operators.observations import range_text

FIXED_KINDS = ("tied", "fixed")
PERCENT_SPAN = 0.2


def adjustable(pars: DataFrame) -> DataFrame:
    return pars.where(~F.col("partrans").isin(*FIXED_KINDS))


def tied(pars: DataFrame) -> DataFrame:
    return pars.where(F.col("partrans") == "tied")


def expand(nested: DataFrame, kind: str = "hru", monthly: bool = False) -> DataFrame:
    """One row per element (and month) of a nested parameter.

    ``nested`` has ``(par, ids ARRAY, values ARRAY<ARRAY<DOUBLE>>)``: the outer
    array holds the months (one for non-monthly parameters), the inner one the
    ids. A length mismatch raises, as the rows could not be named.
    """
    sized = nested.withColumn(
        "_ok", F.forall("values", lambda v: F.size(v) == F.size("ids"))
    ).withColumn("values", F.when(F.col("_ok"), F.col("values")).otherwise(
        F.raise_error(F.lit("parameter values and ids differ in length"))))
    rows = sized.select("par", "ids", F.posexplode("values").alias("_m", "_row")).select(
        "par", "ids", "_m", F.posexplode("_row").alias("_i", "parval1"))
    name = [F.col("par"), F.concat(F.lit(f"{kind}_"), F.get("ids", F.col("_i")).cast("string"))]
    if monthly:
        name.append(F.concat(F.lit("mon_"), (F.col("_m") + 1).cast("string")))
    return rows.select(F.concat_ws(":", *name).alias("parnme"), "parval1")


def bounds_by_method(pars: DataFrame, table: DataFrame) -> DataFrame:
    """Bounds from the table row of the name's first part: a percentage of the start value or a range.

    Negative start values give inverted percent bounds; ``inverted_bounds`` lists them.
    """
    t = table.select(
        F.col("parameter_name").alias("_p"), F.col("method").alias("_method"),
        F.col("par_lower_bound").alias("_lb"), F.col("par_upper_bound").alias("_ub"))
    v = F.col("parval1")
    pct = F.col("_method") == "Percent"
    return (
        pars.drop("parlbnd", "parubnd").withColumn("_p", F.element_at(F.split("parnme", ":"), 1)).join(t, "_p", "left")
        .withColumn("parlbnd", F.when(pct, v - v * PERCENT_SPAN).when(F.col("_method") == "Range", F.col("_lb")))
        .withColumn("parubnd", F.when(pct, v + v * PERCENT_SPAN).when(F.col("_method") == "Range", F.col("_ub")))
        .drop("_p", "_method", "_lb", "_ub")
    )


def inverted_bounds(pars: DataFrame) -> DataFrame:
    return pars.where(F.col("parlbnd") > F.col("parubnd"))


def transform_flag(pars: DataFrame) -> DataFrame:
    """A parameter whose lower bound is not positive cannot be log-transformed."""
    return pars.withColumn("partrans", F.when(F.col("parlbnd") <= 0, "none").otherwise(F.col("partrans")))


def override(pars: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides(parnme, parlbnd, parubnd)`` replaces the bounds of listed rows."""
    o = overrides.select("parnme", F.col("parlbnd").alias("_l"), F.col("parubnd").alias("_u"))
    return (
        pars.join(o, "parnme", "left").withColumn("parlbnd", F.coalesce("_l", "parlbnd"))
        .withColumn("parubnd", F.coalesce("_u", "parubnd")).drop("_l", "_u")
    )


def clip(value: Column, lower: Column, upper: Column) -> Column:
    """Values outside the bounds move to the bound; the lower one is applied last, NULL bounds are open."""
    capped = F.when(value > upper, upper).otherwise(value)
    return F.when(capped < lower, lower).otherwise(capped)


def enforce_bounds(pars: DataFrame) -> DataFrame:
    return pars.withColumn("parval1", clip(F.col("parval1"), F.col("parlbnd"), F.col("parubnd")))


def scaled_log(value: Column) -> Column:
    v = value * F.col("scale") + F.col("offset")
    return F.when(F.col("partrans") == "log", F.log10(v)).otherwise(v)


def transformed_columns(pars: DataFrame) -> DataFrame:
    out = pars
    for c in ("parval1", "parlbnd", "parubnd", "increment"):
        if c in pars.columns:
            out = out.withColumn(f"{c}_trans", scaled_log(F.col(c)))
    return out


def perturbations(pars: DataFrame, groups: DataFrame) -> DataFrame:
    """Increment and perturbed value; a step out of the upper bound goes backward.

    ``groups(pargp, inctyp, derinc)``. ``out_of_bounds`` marks rows that leave
    both bounds, which the caller must treat as an error.
    """
    p = enforce_bounds(pars).join(groups.select("pargp", "inctyp", "derinc"), "pargp")
    largest = p.groupBy("inctyp").agg(F.max("parval1").alias("_max"))
    known = {"absolute", "relative", "rel_to_max"}
    inc = (
        F.when(F.col("partrans") == "fixed", F.col("parval1"))
        .when(F.col("inctyp") == "absolute", F.col("derinc"))
        .when(F.col("inctyp") == "relative", F.col("derinc") * F.col("parval1"))
        .when(F.col("inctyp") == "rel_to_max", F.col("derinc") * F.col("_max"))
    )
    t = p.join(largest, "inctyp").withColumn(
        "increment",
        F.when(F.col("inctyp").isin(*known), inc).otherwise(F.raise_error(F.lit("unknown increment type")).cast("double")))
    forward = F.col("parval1") + F.col("increment")
    back = F.col("parval1") - F.col("increment")
    out = forward > F.col("parubnd")
    return (
        t.withColumn("perturbation", F.when(out, back).otherwise(forward))
        .withColumn("out_of_bounds", out & (back < F.col("parlbnd"))).drop("_max")
    )


def change_limits(
    pars: DataFrame, factor_max: float = 10.0, relative_max: float = 10.0, original: str | None = None, factor_orig: float = 0.001
) -> DataFrame:
    """Factor and relative change limits and the effective limits against the bounds.

    A limit is measured from the current value, or from a quarter of the upper bound where that is 0. ``original`` names the
    column of the starting values: the limit of a parameter that is not log-transformed is then never measured from less than
    ``factor_orig`` of it.
    """
    value = F.col("parval1")
    base = F.when(value == 0, F.col("parubnd") / 4.0).otherwise(value)
    if original is not None:
        least = F.col(original) * factor_orig
        base = F.when((F.col("partrans") != "log") & (F.abs(base) < F.abs(least)), least).otherwise(base)
    t = pars.withColumn("_b", base)
    b, away = F.col("_b"), F.abs("_b")
    # a factor moves the magnitude and leaves the sign; a value of 0 has no factor limits
    ends = F.when(b != 0, F.array_sort(F.array(b * factor_max, b / factor_max)))
    t = t.withColumns({
        "fac_lower": ends[0], "fac_upper": ends[1],
        "rel_lower": b - away * relative_max, "rel_upper": b + away * relative_max,
    }).drop("_b")
    by_kind = {
        f"chg_{side}": F.when(F.col("parchglim") == "factor", F.col(f"fac_{side}"))
        .when(F.col("parchglim") == "relative", F.col(f"rel_{side}")) for side in ("lower", "upper")
    }
    return t.withColumns(by_kind).withColumns({
        "eff_lower": F.greatest("parlbnd", "chg_lower"), "eff_upper": F.least("parubnd", "chg_upper")})


def at_bounds(pars: DataFrame, frac_tol: float = 0.01) -> DataFrame:
    """Adjustable parameters at or near a bound, one row per (parameter, side)."""
    v = F.col("parval1")
    sides = F.filter(
        F.array(
            F.when(v >= (1.0 - frac_tol) * F.col("parubnd"), "upper"),
            F.when(v <= (1.0 + frac_tol) * F.col("parlbnd"), "lower"),
        ),
        lambda s: s.isNotNull(),
    )
    return adjustable(pars).select("parnme", F.explode(sides).alias("side"))


def replace_from_realization(pars: DataFrame, ens: DataFrame, real: str | None = None, clip_to_bounds: bool = False) -> DataFrame:
    """Values of one realization; ``base`` where present, else the smallest integer id."""
    if real is None:
        order = F.when(F.col("real") == "base", F.lit(-1)).otherwise(F.col("real").try_cast("bigint"))
        pick = ens.agg(F.min_by("real", order).alias("real")).scalar()
    else:
        pick = F.lit(real)
    v = ens.where(F.col("real") == pick).select(F.col("name").alias("parnme"), F.col("value").alias("_v"))
    out = pars.join(v, "parnme", "left").withColumn("parval1", F.coalesce("_v", "parval1")).drop("_v")
    return enforce_bounds(out) if clip_to_bounds else out


def log_span(pars: DataFrame) -> Column:
    ub, lb = F.col("parubnd"), F.col("parlbnd")
    return F.when(F.col("partrans") == "log", F.log10(ub) - F.log10(lb)).otherwise(ub - lb)


def prior_equations(pars: DataFrame, by_bounds: bool = True) -> DataFrame:
    """One equation row per adjustable parameter: the parameter stays at its start value.

    Weights are 1 or, by bounds, the inverse of the (log) bound range.
    """
    p = adjustable(pars)
    is_log = F.col("partrans") == "log"
    start = F.when(is_log, F.log10("parval1")).otherwise(F.col("parval1"))
    left = F.when(is_log, F.format_string("1.0 * log(%s)", "parnme")).otherwise(F.format_string("1.0 * %s", "parnme"))
    return p.select(
        F.col("parnme").alias("pilbl"),
        F.concat(left, F.format_string(" = %15.6E", start)).alias("equation"),
        (F.try_divide(F.lit(1.0), log_span(p)) if by_bounds else F.lit(1.0)).alias("weight"),
        F.concat(F.lit("regul_"), F.col("pargp")).alias("obgnme"),
    )


def build_equations(terms: DataFrame) -> DataFrame:
    """Equation text per label from ``(pilbl, ord, parnme, coef, islog, rhs, weight, obgnme)`` term rows."""
    ref = F.when(F.col("islog"), F.format_string("log(%s)", "parnme")).otherwise(F.col("parnme"))
    return (
        terms.withColumn("_t", F.struct("ord", F.format_string("%.6f * %s", "coef", ref).alias("s")))
        .groupBy("pilbl", "rhs", "weight", "obgnme")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("_t")), lambda t: t["s"]), " + ").alias("_lhs"))
        .select("pilbl", F.concat("_lhs", F.format_string(" = %.6f", "rhs")).alias("equation"), "weight", "obgnme")
    )


def equation_parameters(equations: DataFrame) -> DataFrame:
    """(pilbl, parnme) of every parameter an equation refers to."""
    lhs = F.element_at(F.split("equation", "="), 1)
    refs = F.regexp_extract_all(lhs, F.lit(r"\*\s*(?:log\()?([^\s()]+)\)?"), F.lit(1))
    return equations.select("pilbl", F.explode(F.array_distinct(refs)).alias("parnme"))


def drop_broken_equations(equations: DataFrame, pars: DataFrame) -> DataFrame:
    """Remove equations that refer to a parameter which is absent or not adjustable."""
    missing = equation_parameters(equations).join(adjustable(pars).select("parnme"), "parnme", "left_anti")
    return equations.join(missing.select("pilbl").distinct(), "pilbl", "left_anti")


def bounds_report(values: DataFrame, pars: DataFrame) -> DataFrame:
    """Per iteration and group: parameters at the lower, upper or either bound, with a ``total`` row.

    ``values`` has ``(iteration, parnme, value)``.
    """
    p = adjustable(pars).select("parnme", "pargp", "parlbnd", "parubnd")
    low, up = F.col("value") <= F.col("parlbnd"), F.col("value") >= F.col("parubnd")
    return (
        values.join(p, "parnme")
        .groupingSets([[F.col("iteration"), F.col("pargp")], [F.col("iteration")]], "iteration", "pargp")
        .agg(
            F.grouping("pargp").alias("_t"), F.count(F.lit(1)).alias("n"), F.count_if(low).alias("at_lower"),
            F.count_if(up).alias("at_upper"), F.count_if(low | up).alias("at_either"),
        )
        .withColumn("pargp", F.when(F.col("_t") == 1, "total").otherwise(F.col("pargp"))).drop("_t")
    )


def summary_table(pars: DataFrame, sigma_range: float = 4.0, linear: bool = False) -> DataFrame:
    """Per group: count, transform (or ``mixed``), numeric ranges and their text forms."""
    t = pars
    cols = ["parval1", "parlbnd", "parubnd"]
    if not linear:
        for c in cols:
            t = t.withColumn(c, F.when(F.col("partrans") == "log", F.log10(c)).otherwise(F.col(c)))
        t = t.withColumn("stdev", (F.col("parubnd") - F.col("parlbnd")) / sigma_range)
        cols.append("stdev")
    aggs = [F.count(F.lit(1)).alias("count"), F.min("partrans").alias("_t0"), F.max("partrans").alias("_t1")]
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    out = t.groupBy("pargp").agg(*aggs).withColumn(
        "transform", F.when(F.col("_t0") == F.col("_t1"), F.col("_t0")).otherwise("mixed"))
    for c in cols:
        out = out.withColumn(f"{c}_text", range_text(F.col(f"{c}_min"), F.col(f"{c}_max")))
    return out.drop("_t0", "_t1")


def sync_groups(pars: DataFrame, groups: DataFrame, defaults: dict[str, object], key: str = "pargp",
                group_key: str = "pargpnme") -> DataFrame:
    """Groups in use, with their row or the defaults; unused groups disappear."""
    used = pars.select(F.col(key).alias(group_key)).distinct()
    out = used.join(groups, group_key, "left")
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by ``order``; combines map-side instead of sorting a key's rows."""
    others = [c for c in df.columns if c not in (key,)]
    packed = F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in others])).alias("_r")
    return df.groupBy(key).agg(packed).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def combination_groups(incidence: DataFrame) -> DataFrame:
    """Parameters that inform the same set of observation groups share an id.

    ``incidence(obgnme, par, v)``; returns ``(par, pargp, obgnmes)``. The id is
    the rank of the sorted set, so it does not depend on row order.
    """
    sets = incidence.where(F.col("v") != 0).groupBy("par").agg(F.sort_array(F.collect_set("obgnme")).alias("obgnmes"))
    ids = global_row_number(sets.select("obgnmes").distinct(), ["obgnmes"], "_id").select(
        "obgnmes", F.concat(F.lit("obs_combo_"), F.col("_id").cast("string")).alias("pargp"))
    return sets.join(ids, "obgnmes").select("par", "pargp", "obgnmes")


def group_incidence(combos: DataFrame) -> DataFrame:
    """Observation group x parameter group entries of the localisation matrix."""
    return combos.select(F.explode("obgnmes").alias("obgnme"), "pargp").distinct().withColumn("v", F.lit(1))


def localized_pairs(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Join names to prefixes on the first ``:`` part, the form every name has."""
    keyed = names.withColumn("prefix", F.element_at(F.split("parnme", ":"), 1))
    return keyed.join(prefixes, "prefix")


def perturbation_table(pars: DataFrame, num_steps: int, increments: DataFrame) -> DataFrame:
    """Base row plus one row per (parameter, step); a step beyond a bound turns backward.

    ``increments(parnme, increment)``. Long form: only the perturbed value is
    stored, all other parameters of the run stay at their start value.
    """
    step = F.explode(F.sequence(F.lit(1), F.lit(int(num_steps)))).alias("step")
    p = adjustable(pars).join(increments.select("parnme", "increment"), "parnme")
    runs = p.select("parnme", "parval1", "parlbnd", "parubnd", "increment", step)
    forward = F.col("parval1") + F.col("increment") * F.col("step")
    back = F.col("parval1") - F.col("increment") * F.col("step")
    value = F.when((forward > F.col("parubnd")) | (forward < F.col("parlbnd")), back).otherwise(forward)
    rows = runs.select(
        F.concat_ws("_", "parnme", F.col("step").cast("string")).alias("run"), "parnme", value.alias("value"))
    base = adjustable(pars).select(F.lit("base").alias("run"), "parnme", F.col("parval1").alias("value"))
    return base.unionByName(rows)
