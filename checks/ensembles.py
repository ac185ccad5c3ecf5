from __future__ import annotations

from pyspark.sql import functions as F

from brookcal.operators import ensembles as E
from brookcal.operators import parameters as P
from brookcal.operators import sampling as D
from brookcal.operators import scoring as S
from checks.registry import check, q_rnd, q_sig, rnd, sig
from checks.scoring import phi_history
from checks.views import ensemble, observations, par_ensemble, parameters, with_ctes


def _vals(df, digits=9):
    return df.select("real", "name", rnd("value", digits).alias("value"))


@check("S6_residuals_from_ensemble", with_ctes("ensemble", "observations") + f"""
SELECT o.obsnme AS name, o.obgnme AS "group", {q_rnd('max(o.obsval)')} AS measured, o.weight, {q_rnd("max(CASE WHEN real = 'base' THEN value END)")} AS modelled,
 {q_rnd('stddev_samp(value)')} AS std, {q_rnd("max(o.obsval) - max(CASE WHEN real = 'base' THEN value END)")} AS residual
FROM ensemble e JOIN observations o ON o.obsnme = e.name GROUP BY o.obsnme, o.obgnme, o.weight""")
def residuals_from(spark, d):
    t = E.residuals_from_ensemble(ensemble(spark, d), observations(spark, d))
    return t.select("name", "group", "weight", *[rnd(c).alias(c) for c in ("measured", "modelled", "std", "residual")])


@check("S6_residuals_without_base", with_ctes("ensemble", "observations") + f"""
SELECT o.obsnme AS name, {q_rnd("avg(value)")} AS modelled, {q_rnd('stddev_samp(value)')} AS std
FROM ensemble e JOIN observations o ON o.obsnme = e.name WHERE real <> 'base' GROUP BY ALL""")
def residuals_mean(spark, d):
    t = E.residuals_from_ensemble(ensemble(spark, d).where("real <> 'base'"), observations(spark, d))
    return t.select("name", rnd("modelled").alias("modelled"), rnd("std").alias("std"))


@check("S7_residual_template", with_ctes("observations") + f"""
SELECT obsnme AS name, obgnme AS "group", {q_rnd('obsval')} AS measured, {q_rnd('obsval')} AS modelled, 0.0::double AS residual, weight FROM observations""")
def template(spark, d):
    t = E.residual_template(observations(spark, d))
    return t.withColumn("measured", rnd("measured")).withColumn("modelled", rnd("modelled"))


@check("N2_arithmetic", with_ctes("ensemble", "observations") + f"""
SELECT real, name, {q_rnd('(value * 2.0 + value - obsval) / 3.0 + value ** 2', 9)} AS value FROM ensemble JOIN observations ON obsnme = name""")
def arithmetic(spark, d):
    en = ensemble(spark, d)
    row = observations(spark, d).select(F.col("obsnme").alias("name"), F.col("obsval").alias("value"))
    third = E.with_scalar(E.with_row(E.with_ensemble(E.with_scalar(en, "*", 2.0), "+", en), "-", row), "/", 3.0)
    return _vals(E.with_ensemble(third, "+", E.with_scalar(en, "**", 2.0)))


@check("N3_transform", with_ctes("par_ensemble", "parameters") + f"""
SELECT real, name, {q_rnd("CASE WHEN partrans = 'log' THEN log10(value) ELSE value END")} AS value FROM par_ensemble JOIN parameters ON parnme = name""")
def transforms(spark, d):
    return _vals(E.transform(par_ensemble(spark, d), parameters(spark, d)), 6)


@check("N3_back_transform", with_ctes("par_ensemble") + f"SELECT real, name, {q_rnd('value')} AS value FROM par_ensemble")
def back(spark, d):
    p = parameters(spark, d)
    return _vals(E.back_transform(E.transform(par_ensemble(spark, d), p), p), 6)


@check("N4_deviations", with_ctes("ensemble") + f"""
SELECT real, name, {q_rnd('value - avg(value) OVER (PARTITION BY name)', 9)} AS value FROM ensemble""")
def deviations(spark, d):
    return _vals(E.deviations(ensemble(spark, d)))


@check("N4_deviations_from_realization", with_ctes("ensemble") + f"""
SELECT e.real, e.name, {q_rnd('e.value - b.value', 9)} AS value FROM ensemble e JOIN ensemble b ON b.real = 'base' AND b.name = e.name""")
def deviations_base(spark, d):
    return _vals(E.deviations(ensemble(spark, d), "base"))


@check("N16_add_base", with_ctes("ensemble", "observations") + f"""
, e AS (SELECT * FROM ensemble WHERE real <> 'base')
SELECT real, name, {q_rnd('value', 9)} AS value FROM e WHERE cast(real AS bigint) <> (SELECT max(cast(real AS bigint)) FROM e)
UNION ALL SELECT 'base', obsnme, {q_rnd('obsval', 9)} FROM observations""")
def add_base(spark, d):
    control = observations(spark, d).select(F.col("obsnme").alias("name"), F.col("obsval").alias("value"))
    return _vals(E.add_base(ensemble(spark, d).where("real <> 'base'"), control))


@check("N17_nonzero_ensemble", with_ctes("ensemble", "observations") + f"""
SELECT real, name, {q_rnd('value', 9)} AS value FROM ensemble WHERE name IN (SELECT obsnme FROM observations WHERE weight > 0)""")
def nonzero(spark, d):
    return _vals(E.nonzero_names(ensemble(spark, d), observations(spark, d)))


@check("N18_drop_missing", with_ctes("ensemble") + f"""
SELECT real, name, {q_rnd('value', 9)} AS value FROM ensemble WHERE name NOT IN (SELECT name FROM ensemble WHERE value > 0.45)""")
def drop_names(spark, d):
    gaps = ensemble(spark, d).withColumn("value", F.when(F.col("value") <= 0.45, F.col("value")))
    return _vals(E.drop_missing(gaps, "name"))


@check("N18_drop_missing_realizations", with_ctes("ensemble") + f"""
SELECT real, name, {q_rnd('value', 9)} AS value FROM ensemble WHERE real NOT IN (SELECT real FROM ensemble WHERE value > 0.3)""")
def drop_reals(spark, d):
    return _vals(E.drop_missing(ensemble(spark, d).where("value <= 0.3"), "real"))


@check("W13_renumber_survivors", with_ctes("phi_hist") + """
, k AS (SELECT DISTINCT real FROM phi_hist WHERE phi <= (SELECT avg(phi) FROM phi_hist)),
n AS (SELECT real, row_number() OVER (ORDER BY real = 'base', try_cast(real AS bigint)) - 1 AS i, count(*) OVER () AS n FROM k)
SELECT real, CASE WHEN i = n - 1 THEN 'base' ELSE cast(i AS varchar) END AS new_real FROM n""")
def renumber(spark, d):
    phi = phi_history(spark, d)
    cut = phi.agg(F.avg("phi").alias("cutoff")).withColumn("all", F.lit(1))
    kept = S.reject_by_phi(phi.withColumn("all", F.lit(1)), cut, ["all"])
    return E.renumber(kept)


@check("W9_ordered_series", with_ctes("daily") + f"""
SELECT 'flow_mon:' || year(day) || '_' || month(day) || ':' || loc AS name, loc, cast(year(day) AS integer) AS year, cast(month(day) AS integer) AS month,
 {q_rnd('avg(value)')} AS value FROM daily GROUP BY loc, year(day), month(day)""")
def ordered(spark, d):
    from brookcal.functions import names
    from brookcal.operators import series
    from checks.views import daily

    m = series.monthly_mean(daily(spark, d)).select(
        names.build_name("flow_mon", names.month_period(F.col("period")), F.col("loc")).alias("name"), "value")
    return E.ordered_by_location(m).select("name", "loc", "year", "month", rnd("value").alias("value"))


@check("W11_realization_sample")
def sample(spark, d):
    return E.sample_realizations(ensemble(spark, d), 25, seed=7)


@check("A22_ensemble_envelope", with_ctes("ensemble") + f"""
SELECT name, {q_rnd('min(value)', 9)} AS min, {q_rnd('max(value)', 9)} AS max, {q_rnd('quantile_cont(value, 0.05)', 8)} AS q05, {q_rnd('quantile_cont(value, 0.95)', 8)} AS q95
FROM ensemble GROUP BY 1""")
def envelope(spark, d):
    t = E.envelope(ensemble(spark, d))
    return t.select("name", rnd("min", 9).alias("min"), rnd("max", 9).alias("max"), rnd("q05", 8).alias("q05"), rnd("q95", 8).alias("q95"))


@check("A23_parameter_envelope", with_ctes("par_ensemble", "parameters") + f"""
SELECT name, split_part(name, ':', 1) AS pargroup, split_part(name, ':', 2) AS location, {q_rnd('min(value)')} AS par_min, {q_rnd('max(value)')} AS par_max,
 {q_rnd('max(parlbnd)')} AS low_bound, {q_rnd('max(parubnd)')} AS upper_bound, max(parval1) AS starting
FROM par_ensemble JOIN parameters ON parnme = name GROUP BY name""")
def par_envelope(spark, d):
    t = E.parameter_envelope(par_ensemble(spark, d), parameters(spark, d))
    return t.select("name", "pargroup", "location", "starting", *[rnd(c).alias(c) for c in ("par_min", "par_max", "low_bound", "upper_bound")])


@check("A25_change_summary", with_ctes("par_ensemble", "parameters") + f"""
, t AS (SELECT real, name, CASE WHEN partrans = 'log' THEN log10(value) ELSE value END AS a,
 CASE WHEN partrans = 'log' THEN log10(greatest(least(value, parubnd), parlbnd)) ELSE greatest(least(value, parubnd), parlbnd) END AS b
 FROM par_ensemble JOIN parameters ON parnme = name)
SELECT name, {q_rnd('avg(a) - avg(b)', 9)} AS mean_change, {q_rnd('CASE WHEN stddev_samp(a) > 1e-9 THEN 100 * (stddev_samp(a) - stddev_samp(b)) / stddev_samp(a) END', 4)} AS std_change FROM t GROUP BY 1""")
def change(spark, d):
    p = parameters(spark, d)
    first = par_ensemble(spark, d)
    t = E.change_summary(first, E.enforce_reset(first, p), p)
    spread = E.transform(first, p).groupBy("name").agg(F.stddev_samp("value").alias("s"))
    return t.join(spread, "name").select(
        "name", rnd("mean_change", 9).alias("mean_change"), rnd(F.when(F.col("s") > 1e-9, F.col("std_change")), 4).alias("std_change"))


@check("A25_change_histograms", with_ctes("ensemble", "observations") + f"""
, t AS (SELECT e.name, obgnme, weight, avg(value) - avg(least(value, 0.1)) AS mean, 100 * (stddev_samp(value) - stddev_samp(least(value, 0.1))) / stddev_samp(value) AS std
 FROM ensemble e JOIN observations ON obsnme = e.name GROUP BY 1, 2, 3),
g AS (SELECT obgnme AS "group", mean, std FROM t UNION ALL SELECT 'all', mean, std FROM t WHERE weight <> 0),
l AS (SELECT "group", 'mean' AS measure, mean AS v FROM g UNION ALL SELECT "group", 'std', std FROM g),
s AS (SELECT "group", measure, count(*) AS entries, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1, 2),
b AS (SELECT "group", measure, least(floor((v - lo) / ((hi - lo) / 7)) + 1, 7) AS bin, count(*) AS n FROM l JOIN s USING ("group", measure) GROUP BY 1, 2, 3)
SELECT s."group", s.measure, cast(k AS integer) AS bin, {q_rnd('lo + (k - 1) * ((hi - lo) / 7)')} AS low, {q_rnd('lo + k * ((hi - lo) / 7)')} AS high, coalesce(n, 0) AS n, entries,
 {q_rnd('lo')} AS smallest, {q_rnd('hi')} AS largest FROM s CROSS JOIN range(1, 8) AS r(k) LEFT JOIN b ON b."group" = s."group" AND b.measure = s.measure AND b.bin = k""")
def change_by_group(spark, d):
    first = ensemble(spark, d)
    obs = observations(spark, d).select(F.col("obsnme").alias("name"), F.col("obgnme").alias("group"), (F.col("weight") != 0).alias("active"))
    t = E.change_histograms(E.change_summary(first, first.withColumn("value", F.least("value", F.lit(0.1)))), obs, 7)
    return t.select("group", "measure", "bin", "n", "entries", *[rnd(c).alias(c) for c in ("low", "high", "smallest", "largest")])


@check("A30_variance_reduction", with_ctes("ensemble") + f"""
SELECT name, {q_rnd('var_samp(value)', 9)} AS prior_var, {q_rnd('var_samp(least(value, 0.1))', 9)} AS post_var,
 {q_rnd('100 * (1 - var_samp(least(value, 0.1)) / var_samp(value))')} AS percent_reduction FROM ensemble GROUP BY 1""")
def reduction(spark, d):
    en = ensemble(spark, d)
    t = E.variance_reduction(en, en.withColumn("value", F.least("value", F.lit(0.1))))
    return t.select("name", rnd("prior_var", 9).alias("prior_var"), rnd("post_var", 9).alias("post_var"), rnd("percent_reduction").alias("percent_reduction"))


@check("N15_enforce_reset", with_ctes("par_ensemble", "parameters") + f"""
SELECT real, name, {q_rnd('greatest(least(value, parubnd), parlbnd)')} AS value FROM par_ensemble JOIN parameters ON parnme = name""")
def reset(spark, d):
    return _vals(E.enforce_reset(par_ensemble(spark, d), parameters(spark, d)), 6)


def _wide_bounds(spark, d):
    v = F.col("parval1")
    return parameters(spark, d).withColumn("parlbnd", v * 0.78).withColumn("parubnd", v * 1.2401)


@check("N15_enforce_drop", with_ctes("ensemble") + f"""
SELECT real, name, {q_rnd('value', 9)} AS value FROM ensemble WHERE real NOT IN (SELECT real FROM ensemble WHERE value > 0.35 OR value < -0.35)""")
def drop(spark, d):
    pars = observations(spark, d).select(
        F.col("obsnme").alias("parnme"), F.lit(0.0).alias("parval1"), F.lit(-0.35).alias("parlbnd"), F.lit(0.35).alias("parubnd"))
    return _vals(E.enforce_drop(ensemble(spark, d), pars))


@check("N15_enforce_scale", with_ctes("par_ensemble") + f"""
, t AS (SELECT real, name, value AS v, p_retailprice AS b, p_retailprice * 1.2401 AS ub, p_retailprice * 0.78 AS lb FROM par_ensemble JOIN part ON name = p_brand || ':hru_' || p_partkey),
f AS (SELECT real, coalesce(min(CASE WHEN v > ub THEN abs(ub - b) / abs(v - b) WHEN v < lb THEN abs(b - lb) / abs(v - b) END), 1) AS f FROM t GROUP BY 1)
SELECT t.real, name, {q_rnd('CASE WHEN f < 1 THEN b + (v - b) * f ELSE v END')} AS value FROM t JOIN f ON f.real = t.real""")
def scale(spark, d):
    return _vals(E.enforce_scale(par_ensemble(spark, d), _wide_bounds(spark, d)), 6)


_QUANTILES = (0.05, 0.5, 0.95)


@check("N19_quantile_realizations", with_ctes("ensemble", "observations") + f"""
, q AS (SELECT name, p, quantile_cont(value, p) AS qv FROM (SELECT name, list(value) AS l FROM ensemble GROUP BY 1), (SELECT unnest([0.05, 0.5, 0.95]) AS p), LATERAL (SELECT unnest(l) AS value) GROUP BY 1, 2),
d AS (SELECT 'q' || cast(cast(p AS double) AS varchar) AS label, real, sqrt(sum(((value - qv) * weight) ** 2)) AS distance FROM ensemble e JOIN q ON q.name = e.name JOIN observations ON obsnme = e.name GROUP BY 1, 2)
SELECT label, arg_min(real, distance) AS real, {q_rnd('min(distance)')} AS distance FROM d GROUP BY 1""".replace("quantile_cont(value, p) AS qv", "CASE p WHEN 0.05 THEN quantile_cont(value, 0.05) WHEN 0.5 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.95) END AS qv"))
def representative(spark, d):
    t = E.representative_realizations(ensemble(spark, d), observations(spark, d), _QUANTILES)
    return t.select("label", "real", rnd("distance").alias("distance"))


@check("N20_conflict_distance", with_ctes("ensemble", "observations") + f"""
SELECT name, {q_rnd('sq')} AS sq_distance FROM (SELECT name, (avg(value) - max(obsval) * 3) ** 2 / var_samp(value) AS sq
 FROM ensemble JOIN observations ON obsnme = name WHERE weight > 0 GROUP BY 1) WHERE sq > 0.5""")
def distance(spark, d):
    obs = observations(spark, d).withColumn("obsval", F.col("obsval") * 3)
    t = E.conflict_distance(ensemble(spark, d), obs, critical=0.5)
    return t.withColumn("sq_distance", rnd("sq_distance"))


@check("N20_conflict_distance_with_noise")
def noisy_distance(spark, d):
    obs = observations(spark, d)
    reals = ensemble(spark, d)
    std = D.observation_variance(obs.where("weight > 0")).select("name", F.lit(0.0).alias("mean"), F.sqrt("var").alias("std"))
    from brookcal.functions.draws import standard_normal

    noise = reals.join(std, "name").select("real", "name", (F.col("std") * standard_normal(11, F.col("real"), F.col("name"))).alias("value"))
    return E.conflict_distance(reals, obs, critical=0.0, noise=noise)


@check("N27_shared_histogram", with_ctes("ensemble") + """
, l AS (SELECT 'first' AS label, name, value FROM ensemble UNION ALL SELECT 'second', name, value * 0.5 FROM ensemble),
s AS (SELECT *, min(value) OVER (PARTITION BY name) AS lo, max(value) OVER (PARTITION BY name) AS hi FROM l)
SELECT label, name, cast(least(floor((value - lo) / (hi - lo) * 10) + 1, 10) AS integer) AS bin, count(*) AS n FROM s GROUP BY ALL""")
def shared(spark, d):
    en = ensemble(spark, d)
    both = en.withColumn("label", F.lit("first")).unionByName(
        en.withColumn("label", F.lit("second")).withColumn("value", F.col("value") * 0.5))
    return E.shared_histogram(both)


@check("N28_run_example", with_ctes("ensemble", "observations") + f"""
SELECT e.name, {q_rnd('value', 9)} AS modelled, {q_rnd('value * 1.1', 9)} AS measured, obgnme AS "group", weight, {q_rnd('abs(obsval) * 0.1', 9)} AS standard_deviation
FROM ensemble e JOIN observations ON obsnme = name WHERE real = 'base'""")
def example(spark, d):
    en = ensemble(spark, d)
    obs = observations(spark, d).withColumn("standard_deviation", F.abs("obsval") * 0.1)
    t = E.run_example(en, E.with_scalar(en, "*", 1.1), obs)
    return t.select("name", "group", "weight", *[rnd(c, 9).alias(c) for c in ("modelled", "measured", "standard_deviation")])


@check("U3_name_difference", with_ctes("ensemble", "observations") + """
SELECT name, 'left' AS only_in FROM (SELECT DISTINCT name FROM ensemble WHERE name NOT IN (SELECT obsnme FROM observations WHERE weight > 0))""")
def name_difference(spark, d):
    obs = observations(spark, d).where("weight > 0").select(F.col("obsnme").alias("name"))
    return E.difference_of_names(ensemble(spark, d), obs)


# draws ------------------------------------------------------------------------


@check("N8_observation_variance", with_ctes("observations") + f"""
SELECT obsnme AS name, {q_sig('CASE WHEN obsval > 0.06 THEN 0.25 ELSE (1 / greatest(weight, 1e-30)) ** 2 END')} AS var FROM observations""")
def obs_variance(spark, d):
    obs = observations(spark, d).withColumn("standard_deviation", F.when(F.col("obsval") > 0.06, F.lit(0.5)))
    return D.observation_variance(obs).withColumn("var", sig("var"))


@check("N8_parameter_variance", with_ctes("parameters") + f"""
SELECT parnme AS name, {q_rnd('''((CASE WHEN partrans = 'log' THEN log10(parubnd * scale) - log10(parlbnd * scale) ELSE (parubnd - parlbnd) * scale END) / 4) ** 2''')} AS var, false AS invalid
FROM parameters WHERE partrans NOT IN ('tied', 'fixed')""")
def par_variance(spark, d):
    return D.parameter_variance(parameters(spark, d)).withColumn("var", rnd("var"))


@check("N11_gaussian_draw", with_ctes("observations") + """
SELECT obsnme AS name, 4000 AS n, true AS mean_ok, true AS std_ok FROM observations""")
def gaussian(spark, d):
    """Moments of 4000 draws per name lie within six standard errors."""
    n = 4000
    table = observations(spark, d).select(F.col("obsnme").alias("name"), F.col("obsval").alias("mean"), (F.col("weight") + 1).alias("std"))
    m = D.gaussian_draw(table, n, seed=3).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("a"), F.stddev_samp("value").alias("s")).join(table, "name")
    err = F.col("std") / n**0.5
    return m.select("name", F.col("n").cast("int").alias("n"), (F.abs(F.col("a") - F.col("mean")) < 6 * err).alias("mean_ok"),
                    (F.abs(F.col("s") - F.col("std")) < 6 * err).alias("std_ok"))


@check("N12_uniform_and_triangular_draw", with_ctes("parameters") + """
, k AS (SELECT unnest(['uniform', 'triangular']) AS how)
SELECT how, parnme AS name, true AS inside, true AS mean_ok FROM parameters, k WHERE partrans NOT IN ('tied', 'fixed')""")
def flat(spark, d):
    pars = P.enforce_bounds(parameters(spark, d)).where("partrans NOT IN ('tied', 'fixed')")
    space = lambda c: F.when(F.col("partrans") == "log", F.log10(F.col(c))).otherwise(F.col(c))
    known = pars.withColumns({f"_{c}": space(c) for c in ("parlbnd", "parval1", "parubnd")})
    lo, mid, hi = F.col("_parlbnd"), F.col("_parval1"), F.col("_parubnd")
    out = None
    for how in ("uniform", "triangular"):
        centre = (lo + hi) / 2 if how == "uniform" else (lo + mid + hi) / 3
        draws = D.parameter_draw(pars, 800, seed=5, default=how)
        # sums by name come before the join, so that it meets one row a name and not each draw
        sums = draws.groupBy("name").agg(
            F.min("value").alias("_least"), F.max("value").alias("_most"),
            *[f(v).alias(c + k) for k, v in (("_lin", F.col("value")), ("_log", F.log10("value"))) for f, c in ((F.avg, "_a"), (F.count, "_n"))])
        log = F.col("partrans") == "log"
        a, n = (F.when(log, F.col(c + "_log")).otherwise(F.col(c + "_lin")) for c in ("_a", "_n"))
        bounds = (F.col("parlbnd"), F.col("parubnd"))
        t = sums.join(known, F.col("parnme") == F.col("name")).withColumn("_d", a - centre).groupBy("name").agg(
            F.bool_and(F.col("_least").between(*bounds) & F.col("_most").between(*bounds)).alias("inside"),
            F.abs(F.try_divide(F.sum(F.col("_d") * n), F.sum(F.when(F.col("_d").isNotNull(), n)))).alias("_off"),
            F.max(6 * (hi - lo) / (12 * 800) ** 0.5).alias("_err"),
        ).select(F.lit(how).alias("how"), "name", "inside", (F.col("_off") <= F.col("_err")).alias("mean_ok"))
        out = t if out is None else out.unionByName(t)
    return out


@check("N13_mixed_draw", with_ctes("parameters") + """
SELECT parnme AS name, 50 AS n, true AS inside, partrans IN ('tied', 'fixed') AS constant FROM parameters""")
def mixed(spark, d):
    pars = P.enforce_bounds(parameters(spark, d))
    how = pars.select("parnme", F.when(F.col("parchglim") == "factor", "uniform").otherwise("triangular").alias("how")).where("how = 'uniform'")
    m = D.parameter_draw(pars, 50, seed=9, how=how).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return m.join(pars, F.col("parnme") == F.col("name")).select(
        "name", F.col("n").cast("int").alias("n"),
        ((F.col("lo") >= F.least("parlbnd", "parval1")) & (F.col("hi") <= F.greatest("parubnd", "parval1"))).alias("inside"),
        (F.col("lo") == F.col("hi")).alias("constant"))
