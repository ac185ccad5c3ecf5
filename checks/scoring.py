from __future__ import annotations

from pyspark.sql import functions as F

from brookcal.functions import names
from brookcal.functions.metrics import METRICS
from brookcal.operators import scoring as S
from checks.registry import check, q_rnd, q_sig, rnd, sig
from checks.views import _cte, daily, ensemble, observations, read, residuals, with_ctes

_R = """CASE WHEN "group" LIKE 'g\\_%' ESCAPE '\\' AND modelled >= measured THEN 0.0
 WHEN "group" LIKE 'l\\_%' ESCAPE '\\' AND modelled <= measured THEN 0.0 ELSE measured - modelled END"""
_cte("scored", f"SELECT *, {_R} AS r, ({_R}) * weight AS wr FROM residuals", ("residuals",))
_cte("comps", 'SELECT "group", sum(wr * wr) AS phi FROM scored GROUP BY 1', ("scored",))
_cte("ens_res", """
SELECT e.real, e.name, o.obgnme AS "group", o.obsval AS measured, e.value AS modelled, o.weight
FROM ensemble e JOIN observations o ON o.obsnme = e.name""", ("ensemble", "observations"))
_cte("phi_vec", "SELECT real, sum(((modelled - measured) * weight) ** 2) AS phi FROM ens_res WHERE weight > 0 GROUP BY real", ("ens_res",))


@check("entry_range_target_phi", with_ctes("daily") + f"""
, m AS (SELECT loc, cast(date_trunc('month', day) AS date) AS period, avg(value) AS v FROM daily
  WHERE day BETWEEN date '1996-01-01' AND date '2000-12-31' GROUP BY 1, 2),
t AS (SELECT loc, cast(date_trunc('month', day) AS date) AS period, min(value) + 5 AS lo, max(value) - 5 AS hi FROM daily
  WHERE day BETWEEN date '1996-01-01' AND date '2000-12-31' GROUP BY 1, 2),
s AS (SELECT 'l_max_flow_mon' AS obgnme, sum(CASE WHEN v <= hi THEN 0 ELSE (hi - v) * 5 * (hi - v) * 5 END) AS phi FROM m JOIN t USING (loc, period)
 UNION ALL SELECT 'g_min_flow_mon', sum(CASE WHEN v >= lo THEN 0 ELSE (lo - v) * 5 * (lo - v) * 5 END) FROM m JOIN t USING (loc, period))
SELECT obgnme, {q_sig('phi')} AS phi, {q_rnd('phi / (SELECT sum(phi) FROM s)')} AS share FROM s""")
def range_target(spark, d):
    days = daily(spark, d, "1996-01-01", "2000-12-31")
    bins = days.groupBy("loc", F.trunc("day", "month").alias("period")).agg(
        F.avg("value").alias("modelled"), (F.min("value") + 5).alias("lo"), (F.max("value") - 5).alias("hi"))
    per, loc = names.month_period(F.col("period")), F.col("loc")
    sides = F.array(
        F.struct(F.lit("l_max_flow_mon").alias("group"), F.col("hi").alias("measured")),
        F.struct(F.lit("g_min_flow_mon").alias("group"), F.col("lo").alias("measured")))
    res = bins.select("loc", "period", "modelled", F.explode(sides).alias("t")).select(
        names.build_name(F.col("t.group"), per, loc).alias("name"), "t.group", "t.measured", "modelled",
        F.lit(5.0).alias("weight"))
    return S.phi_normalised(res).select(F.col("group").alias("obgnme"), sig("phi").alias("phi"), rnd("share").alias("share"))


@check("A7_phi_components", with_ctes("comps") + f"""
SELECT "group", {q_sig('phi')} AS phi FROM comps UNION ALL SELECT 'total', {q_sig('sum(phi)')} FROM comps""")
def components(spark, d):
    return S.phi_with_total(residuals(spark, d)).withColumn("phi", sig("phi"))


@check("A8_phi_normalised", with_ctes("comps") + f"""
SELECT "group", {q_sig('phi')} AS phi, {q_rnd('phi / (SELECT sum(phi) FROM comps)', 9)} AS share FROM comps""")
def normalised(spark, d):
    return S.phi_normalised(residuals(spark, d)).select("group", sig("phi").alias("phi"), rnd("share", 9).alias("share"))


@check("A9_equation_phi", with_ctes("residuals") + f"""
SELECT "group", {q_sig('''sum((CASE WHEN "group" LIKE 'g%' AND measured - modelled >= 0 OR "group" LIKE 'l%' AND measured - modelled <= 0 THEN 0
 ELSE (measured - modelled) * weight END) ** 2)''')} AS phi FROM residuals GROUP BY 1""")
def equation(spark, d):
    eq = residuals(spark, d).withColumn("residual", F.col("measured") - F.col("modelled"))
    return S.equation_phi(eq).withColumn("phi", sig("phi"))


_TARGETS = {"l_max_a": 100.0, "g_min_a": 0.0, "flow_n": 2500.0}


@check("A10_reweight_groups", with_ctes("comps") + f"""
SELECT name, {q_sig('''CASE s."group" WHEN 'l_max_a' THEN weight * sqrt(100.0 / phi) WHEN 'flow_n' THEN weight * sqrt(2500.0 / phi)
 WHEN 'g_min_a' THEN 0 ELSE weight END''')} AS weight FROM scored s JOIN comps c ON c."group" = s."group" """)
def reweight(spark, d):
    out = S.reweight_groups(residuals(spark, d), S.targets_from(_TARGETS, spark))
    return out.select("name", sig("weight").alias("weight"))


@check("A10_reweight_restart", with_ctes("observations", "ensemble") + f"""
, m AS (SELECT o.*, e.value AS modelled FROM observations o JOIN ensemble e ON e.name = o.obsnme AND e.real = 'base'),
g AS (SELECT obgnme, sum((obsval - modelled) ** 2) AS phi1 FROM m GROUP BY 1)
SELECT obsnme AS name, {q_sig("CASE WHEN m.obgnme IN ('plain_0', 'plain_4') THEN sqrt(10 / phi1) ELSE weight END")} AS weight
FROM m JOIN g ON g.obgnme = m.obgnme""")
def reweight_restart(spark, d):
    base = ensemble(spark, d).where("real = 'base'")
    res = S.ensemble_residuals(base, observations(spark, d))
    out = S.reweight_groups(res, S.targets_from({"plain_0": 10.0, "plain_4": 10.0}, spark))
    return out.select("name", sig("weight").alias("weight"))


@check("A10_reweight_observations", with_ctes("scored") + f"""
SELECT name, {q_sig('''CASE WHEN "group" <> 'flow_n' THEN weight ELSE (CASE WHEN weight = 0 THEN 1 ELSE weight END)
 * coalesce(sqrt(4 / nullif((r * (CASE WHEN weight = 0 THEN 1 ELSE weight END)) ** 2, 0)), 1) END''')} AS weight FROM scored""")
def reweight_each(spark, d):
    res = residuals(spark, d)
    t = res.where("group = 'flow_n'").select("name", F.lit(4.0).alias("target"))
    return S.reweight_observations(res, t).select("name", sig("weight").alias("weight"))


def _daily_named(spark, d):
    g = F.col("group")
    return residuals(spark, d).withColumn(
        "group", F.when(g == "flow_n", "streamflow_daily_low").when(g == "l_max_r", "streamflow_daily_pulse_asc")
        .when(g == "g_min_r", "streamflow_daily_exlow").when(g == "l_max_a", "streamflow_daily_large_dsc").otherwise(g))


_cte("daily_named", """
SELECT name, CASE "group" WHEN 'flow_n' THEN 'streamflow_daily_low' WHEN 'l_max_r' THEN 'streamflow_daily_pulse_asc'
 WHEN 'g_min_r' THEN 'streamflow_daily_exlow' WHEN 'l_max_a' THEN 'streamflow_daily_large_dsc' ELSE "group" END AS "group",
 CASE WHEN "group" = 'g_min_a' AND modelled >= measured THEN 0.0 ELSE (measured - modelled) * weight END AS wr FROM residuals""", ("residuals",))
_cte("daily_comps", """
SELECT "group", sum(wr * wr) AS phi, count(*) AS n, "group" IN ('streamflow_daily_low', 'streamflow_daily_exlow') AS is_low
FROM daily_named GROUP BY 1""", ("daily_named",))


@check("A11_target_contributions", with_ctes("daily_comps") + f"""
SELECT "group", {q_sig('phi')} AS phi, {q_rnd("fraction")} AS fraction, {q_sig("fraction * (SELECT sum(phi) FROM daily_comps)")} AS target,
 {q_rnd('sum(fraction) over ()')} AS fraction_sum
FROM (SELECT "group", phi, CASE WHEN "group" = 'g_min_a' THEN 0.8
  ELSE phi / sum(phi) OVER (PARTITION BY is_low, "group" LIKE 'streamflow%') * (CASE WHEN is_low THEN 0.12 ELSE 0.08 END) END AS fraction FROM daily_comps)""")
def contributions(spark, d):
    fr = spark.createDataFrame([("g_min_a", 0.8)], "group string, fraction double")
    t = S.target_contributions(_daily_named(spark, d), fr)
    return t.select("group", sig("phi").alias("phi"), rnd("fraction").alias("fraction"), sig("target").alias("target"),
                    rnd("fraction_sum").alias("fraction_sum"))


@check("A28_daily_flow_classes", with_ctes("daily_comps") + f"""
SELECT CASE WHEN is_low THEN 'low' ELSE 'high' END AS class, cast(sum(n) AS bigint) AS n, {q_sig('sum(phi)')} AS phi
FROM daily_comps WHERE "group" LIKE 'streamflow%' GROUP BY 1""")
def flow_counts(spark, d):
    return S.daily_flow_classes(_daily_named(spark, d)).withColumn("phi", sig("phi"))


@check("A12_discrepancy_weights", with_ctes("scored") + f"""
SELECT name, {q_sig('CASE WHEN weight = 0 THEN 0 WHEN wr = 0 THEN weight ELSE weight * least(1, 1 / abs(wr)) END')} AS weight FROM scored""")
def discrepancy(spark, d):
    return S.discrepancy_weights(residuals(spark, d)).select("name", sig("weight").alias("weight"))


@check("A12_discrepancy_by_group", with_ctes("scored") + f"""
, g AS (SELECT "group" AS grp, sum(wr * wr) AS phi, count(CASE WHEN weight <> 0 THEN 1 END) AS nz FROM scored GROUP BY 1)
SELECT name, {q_sig('weight * (CASE WHEN phi > 0 THEN sqrt(nz / phi) ELSE 1 END)')} AS weight FROM scored JOIN g ON grp = "group" """)
def discrepancy_group(spark, d):
    return S.discrepancy_weights(residuals(spark, d), original_ceiling=False, by_groups=True).select(
        "name", sig("weight").alias("weight"))


@check("A13_residual_statistics", with_ctes("residuals") + f"""
SELECT coalesce("group", 'total') AS "group", {q_sig('sum(((modelled - measured) * weight) ** 2)')} AS rss, {q_sig('avg(modelled - measured)')} AS mean,
 {q_sig('avg(abs(modelled - measured))')} AS mae, {q_sig('sqrt(avg((modelled - measured) ** 2))')} AS rmse,
 {q_sig('sqrt(avg((modelled - measured) ** 2)) / (max(measured) - min(measured))')} AS nrmse
FROM residuals WHERE weight > 0 GROUP BY GROUPING SETS (("group"), ())""")
def statistics(spark, d):
    t = S.residual_statistics(residuals(spark, d))
    return t.select("group", *[sig(c).alias(c) for c in ("rss", "mean", "mae", "rmse", "nrmse")])


def _metric_sql(compat: bool = False) -> str:
    var = "var_pop(modelled)" if compat else "var_pop(measured)"
    nse = f"(1 - sum((modelled - measured) ** 2) / (count(*) * {var}))"
    bias = "(sum(modelled - measured) / sum(measured) / count(*))"
    rmse = "sqrt(avg((modelled - measured) ** 2))"
    se = "sqrt(sum((modelled - measured) ** 2) / (count(*) - 1))"
    forms = {
        "pbias": "100 * sum(modelled - measured) / sum(measured)", "bias": bias,
        "relative_bias": f"{bias} / avg(measured)", "rmse": rmse, "mse": "avg((modelled - measured) ** 2)",
        "nse": nse, "nnse": f"1 / (2 - {nse})", "mae": "avg(abs(modelled - measured))",
        "kge": "1 - sqrt((corr(measured, modelled) - 1) ** 2 + (stddev_pop(modelled) / stddev_pop(measured) - 1) ** 2"
               " + (sum(modelled) / sum(measured) - 1) ** 2)",
        "nrmse_sd": f"{rmse} / stddev_pop(measured)", "nrmse_mean": f"{rmse} / avg(measured)",
        "nrmse_iq": f"{rmse} / (quantile_cont(measured, 0.75) - quantile_cont(measured, 0.25))",
        "nrmse_maxmin": f"{rmse} / (max(measured) - min(measured))", "standard_error": se,
        "volumetric_efficiency": "1 - sum(abs(modelled - measured)) / sum(measured)",
        "relative_standard_error": f"{se} / stddev_samp(measured)",
    }
    return ", ".join(f"{_m(forms[m])} AS {m}" for m in METRICS)


def _m(x: str) -> str:
    return f"cast(printf('%.6e', cast({x} as double)) as double)"


def _sig6(c: str):
    return F.format_string("%.6e", F.col(c)).try_cast("double")


@check("A14_fit_metrics", with_ctes("residuals") + f"""
SELECT coalesce("group", 'total') AS "group", {_metric_sql()} FROM residuals WHERE weight <> 0 GROUP BY GROUPING SETS (("group"), ())""")
def metrics(spark, d):
    return S.fit_metrics(residuals(spark, d)).select("group", *[_sig6(m).alias(m) for m in METRICS])


@check("A14_fit_metrics_compat", with_ctes("residuals") + f"""
SELECT coalesce("group", 'total') AS "group", {_metric_sql(True)} FROM residuals GROUP BY GROUPING SETS (("group"), ())""")
def metrics_compat(spark, d):
    t = S.fit_metrics(residuals(spark, d), drop_zero_weight=False, compat=True)
    return t.select("group", *[_sig6(m).alias(m) for m in METRICS])


@check("A15_ensemble_fit_metrics", with_ctes("ens_res") + f"""
SELECT real, coalesce("group", 'total') AS "group", {_metric_sql()} FROM ens_res WHERE weight <> 0 GROUP BY GROUPING SETS ((real, "group"), (real))""")
def ensemble_metrics(spark, d):
    t = S.ensemble_fit_metrics(ensemble(spark, d), observations(spark, d))
    return t.select("real", "group", *[_sig6(m).alias(m) for m in METRICS])


def _conflicts(spark, d):
    return residuals(spark, d).where(F.col("modelled") > 4 * F.col("measured")).select("name")


@check("A16_conflict_summary", with_ctes("residuals") + """
, c AS (SELECT "group" AS obgnme, count(*) AS obs_counts, count(CASE WHEN modelled > 4 * measured THEN 1 END) AS hits,
  count(CASE WHEN weight > 0 THEN 1 END) AS nz FROM residuals GROUP BY 1)
SELECT obgnme, CASE WHEN nz > 0 THEN obs_counts END AS obs_counts, nullif(hits, 0) AS pdc_counts,
 round(nullif(hits, 0) / obs_counts::double, 9) AS fraction FROM c WHERE nz > 0 OR hits > 0""")
def conflict(spark, d):
    obs = residuals(spark, d).select(F.col("name").alias("obsnme"), F.col("group").alias("obgnme"), "weight")
    t = S.conflict_summary(obs, _conflicts(spark, d))
    return t.select("obgnme", "obs_counts", "pdc_counts", F.round("fraction", 9).alias("fraction"))


@check("A16_conflict_percent", with_ctes("residuals") + f"""
SELECT count(CASE WHEN weight > 0 THEN 1 END) AS nonzero_obs, {q_rnd('100.0 * count(CASE WHEN modelled > 4 * measured THEN 1 END) / count(CASE WHEN weight > 0 THEN 1 END)')} AS percent
FROM residuals""")
def conflict_share(spark, d):
    return S.conflict_percent(residuals(spark, d), _conflicts(spark, d)).withColumn("percent", rnd("percent"))


@check("J4_outer_count_merge", """
SELECT coalesce(a.user_id, b.user_id) AS user_id, n_errors, n_signups FROM
 (SELECT user_id, count(*) AS n_errors FROM events WHERE event_type = 'error' GROUP BY 1) a FULL JOIN
 (SELECT user_id, count(*) AS n_signups FROM events WHERE event_type = 'signup' GROUP BY 1) b ON a.user_id = b.user_id""")
def outer_counts(spark, d):
    ev = read(spark, d, "events")
    a = ev.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_errors"))
    b = ev.where("event_type = 'signup'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_signups"))
    return S.merge_counts(a, b, "user_id")


@check("N1_phi_vector", with_ctes("phi_vec") + f"SELECT real, {q_sig('phi')} AS phi FROM phi_vec")
def phi_by_real(spark, d):
    return S.phi_vector(ensemble(spark, d), observations(spark, d)).withColumn("phi", sig("phi"))


def phi_history(spark, d):
    """(run, real, phi): the phi of every realization, a run per label."""
    label = read(spark, d, "embeddings").select(
        F.when(F.col("vec_id") == 0, "base").otherwise(F.col("vec_id").cast("string")).alias("real"),
        F.col("label").cast("string").alias("run"))
    return S.phi_vector(ensemble(spark, d), observations(spark, d)).join(label, "real")


_cte("phi_hist", """
SELECT real, phi, cast(label AS varchar) AS run FROM phi_vec JOIN embeddings ON real = CASE WHEN vec_id = 0 THEN 'base' ELSE cast(vec_id AS varchar) END""", ("phi_vec",))


@check("W12_rejection_by_phi", with_ctes("phi_hist") + f"""
SELECT p.run, real, {q_sig('phi')} AS phi FROM phi_hist p JOIN (SELECT run, avg(phi) AS cutoff FROM phi_hist GROUP BY run) c ON c.run = p.run WHERE phi <= cutoff""")
def rejection(spark, d):
    phi = phi_history(spark, d)
    cut = phi.groupBy("run").agg(F.avg("phi").alias("cutoff"))
    return S.reject_by_phi(phi, cut).select("run", "real", sig("phi").alias("phi"))


@check("W14_log_phi_history", with_ctes("phi_hist") + f"SELECT run, real, {q_rnd('log10(phi)')} AS log_phi FROM phi_hist")
def log_history(spark, d):
    return S.log_phi_history(phi_history(spark, d)).select("run", "real", rnd("log_phi").alias("log_phi"))


@check("A24_phi_histogram", """
SELECT CAST(least(floor((v - mn) / (mx - mn) * 50) + 1, 50) AS integer) AS bin, count(*) AS n
FROM (SELECT o_totalprice AS v, min(o_totalprice) OVER () AS mn, max(o_totalprice) OVER () AS mx FROM orders) GROUP BY 1""")
def histogram(spark, d):
    return S.phi_histogram(read(spark, d, "orders").select(F.col("o_totalprice").alias("phi")))


@check("J1_model_vs_reference_run", with_ctes("residuals") + f"""
SELECT r.name, measured, {q_sig('modelled')} AS modelled, {q_sig('o_totalprice / 5')} AS alternative
FROM residuals r JOIN orders ON cast(o_orderkey AS varchar) || ':1' = r.name""")
def versus(spark, d):
    other = read(spark, d, "orders").select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(":1")).alias("name"), (F.col("o_totalprice") / 5).alias("value"))
    t = S.compare_runs(residuals(spark, d), other)
    return t.select("name", "measured", sig("modelled").alias("modelled"), sig("alternative").alias("alternative"))


@check("N26_one_to_one", with_ctes("residuals") + f"""
SELECT name, "group", {q_sig('modelled - measured')} AS res, {q_sig('0.9 * min(least(measured, modelled)) OVER (PARTITION BY "group")')} AS axis_min,
 {q_sig('1.1 * max(greatest(measured, modelled)) OVER (PARTITION BY "group")')} AS axis_max FROM residuals WHERE weight > 0""")
def pairs(spark, d):
    t = S.one_to_one(residuals(spark, d))
    return t.select("name", "group", *[sig(c).alias(c) for c in ("res", "axis_min", "axis_max")])


@check("F2_metric_registry", with_ctes("residuals") + f"""
SELECT coalesce("group", 'total') AS "group", {_m('sqrt(avg((modelled - measured) ** 2))')} AS rmse, {_m('max(measured) / avg(measured)')} AS peak_ratio
FROM residuals WHERE weight <> 0 GROUP BY GROUPING SETS (("group"), ())""")
def registry(spark, d):
    from brookcal.functions import metrics as M

    M.register("peak_ratio", lambda k: F.col("omax") / (F.col("so") / F.col("n")))
    try:
        t = S.fit_metrics(residuals(spark, d), ["RMSE", "peak_ratio"])
    finally:
        M.METRICS.pop("peak_ratio")
    return t.select("group", _sig6("rmse").alias("rmse"), _sig6("peak_ratio").alias("peak_ratio"))
