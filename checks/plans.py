from __future__ import annotations

from pyspark.sql import functions as F

from brookcal.plans import model_output, trimmed_ensemble, weighted_observations
from checks.observations import noise_table
from checks.registry import check, q_rnd, rnd
from checks.regime import _CLASSES
from checks.scoring import phi_history
from checks.views import daily_by_var, ensemble, gauge_flow, observations, par_ensemble, parameters, with_ctes

TARGETS = [
    model_output.Target("actet_mon", "A", "mon", "1996-01-01", "2000-12-31"),
    model_output.Target("actet_mean_mon", "A", "mean_mon", "1996-01-01", "2000-12-31"),
    model_output.Target("recharge_ann", "N", "ann", "1997-01-01", "1999-12-31", normalise=True),
    model_output.Target("sca_daily", "R", "daily", "1998-01-01", "1998-12-31", exclude_months=(7, 8)),
    model_output.Target("streamflow_mon", "R", "mon", "1996-01-01", "2000-12-31", per_second=True),
]


@check("plan_model_output", with_ctes("daily_by_var") + f"""
, a AS (SELECT loc, date_trunc('month', day) AS m, avg(value) AS v FROM daily_by_var WHERE var = 'A' AND day BETWEEN date '1996-01-01' AND date '2000-12-31' GROUP BY 1, 2),
n AS (SELECT loc, year(day) AS y, avg(value) AS v FROM daily_by_var WHERE var = 'N' AND day BETWEEN date '1997-01-01' AND date '1999-12-31' GROUP BY 1, 2)
SELECT 'actet_mon:' || year(m) || '_' || month(m) || ':' || loc AS obsnme, {q_rnd('v', 9)} AS obsval, 'actet_mon' AS obgnme FROM a
UNION ALL SELECT 'actet_mean_mon:' || month(m) || ':' || loc, {q_rnd('avg(v)', 9)}, 'actet_mean_mon' FROM a GROUP BY loc, month(m)
UNION ALL SELECT 'recharge_ann:' || y || ':' || loc, {q_rnd('(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())', 9)}, 'recharge_ann' FROM n
UNION ALL SELECT 'sca_daily:' || year(day) || '_' || month(day) || '_' || day(day) || ':' || loc, {q_rnd('value', 9)}, 'sca_daily' FROM daily_by_var
  WHERE var = 'R' AND year(day) = 1998 AND month(day) NOT IN (7, 8)
UNION ALL SELECT 'streamflow_mon:' || year(day) || '_' || month(day) || ':' || loc, {q_rnd('avg(value / 86400)', 9)}, 'streamflow_mon' FROM daily_by_var
  WHERE var = 'R' AND day BETWEEN date '1996-01-01' AND date '2000-12-31' GROUP BY loc, year(day), month(day)""")
def outputs(spark, d):
    return model_output.observation_equivalents(daily_by_var(spark, d), TARGETS).withColumn("obsval", rnd("obsval", 9))


@check("plan_weighted_observations", _CLASSES + f"""
, o AS (SELECT *, efc < 1 AS none, CASE efc WHEN 1 THEN 'large' WHEN 2 THEN 'small' WHEN 3 THEN 'pulse' END AS size FROM classes),
g AS (SELECT 'streamflow_daily_' || (CASE WHEN none THEN '-9999_-9999' ELSE efc || '_' || high_low END) || ':' || year(day) || '_' || month(day) || '_' || day(day) || ':' || loc AS obsnme,
 discharge AS obsval, CASE WHEN none THEN 'streamflow_nodata' WHEN efc = 4 THEN 'streamflow_daily_low' WHEN efc = 5 THEN 'streamflow_daily_exlow'
  ELSE 'streamflow_daily_' || size || CASE high_low WHEN 2 THEN '_asc' ELSE '_dsc' END END AS obgnme FROM o)
SELECT obsnme, obgnme, {q_rnd('0.1 * obsval')} AS standard_deviation, {q_rnd("CASE WHEN obsval <= 1 THEN 1 WHEN obgnme = 'streamflow_nodata' THEN 0 ELSE 10 / obsval END")} AS weight FROM g""")
def weighted(spark, d):
    parts = [weighted_observations.daily_flow_observations(gauge_flow(spark, d))]
    t = weighted_observations.weighted_table(parts, noise_table(spark))
    return t.select("obsnme", "obgnme", rnd("standard_deviation").alias("standard_deviation"), rnd("weight").alias("weight"))


@check("plan_trimmed_ensemble", with_ctes("phi_hist", "ensemble") + f"""
, k AS (SELECT DISTINCT real FROM phi_hist WHERE phi <= (SELECT avg(phi) FROM phi_hist)),
n AS (SELECT real, row_number() OVER (ORDER BY real = 'base', try_cast(real AS bigint)) - 1 AS i, count(*) OVER () AS n FROM k)
SELECT CASE WHEN i = n - 1 THEN 'base' ELSE cast(i AS varchar) END AS real, name, {q_rnd('value', 9)} AS value FROM ensemble JOIN n ON n.real = ensemble.real""")
def trimmed(spark, d):
    phi = phi_history(spark, d).withColumn("run", F.lit("all"))
    cut = phi.groupBy("run").agg(F.avg("phi").alias("cutoff"))
    t = trimmed_ensemble.trim(phi, cut, ["run"], ensemble(spark, d), par_ensemble(spark, d), observations(spark, d), parameters(spark, d))
    return t.restart_observations.select("real", "name", rnd("value", 9).alias("value"))
