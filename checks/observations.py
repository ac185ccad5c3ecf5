from __future__ import annotations

from pyspark.sql import functions as F

from brookcal.functions import inequality
from brookcal.operators import observations as O
from checks.registry import check, q_rnd, q_sig, rnd, sig
from checks.views import _cte, daily, observations, parameters, read, residuals, with_ctes

# Observation kinds by calendar month, used to build names from the daily series.
KINDS = (
    "l_max_actet_mon", "g_min_actet_mon", "l_max_actet_mean_mon", "l_max_sca_daily", "g_min_sca_daily",
    "streamflow_mon", "streamflow_mean_mon", "streamflow_daily_1_2", "streamflow_daily_4_1",
    "streamflow_daily_5_1", "streamflow_daily_-9999_-9999", "unknown_kind",
)
_KIND_SQL = "CASE month(day) " + " ".join(f"WHEN {i + 1} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
EXCLUDED = "s_acctbal < 500"


def named_obs(spark, d):
    v = F.col("value")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.month("day") - 1)
    period = F.concat_ws("_", F.year("day"), F.month("day"), F.day("day"))
    return daily(spark, d).select(
        F.concat_ws(":", kind, period, F.col("loc")).alias("obsnme"),
        F.when(v < 3, -9999.0).when(v < 6, v / 10).otherwise(v).alias("obsval"))


_cte("named_obs", f"""
SELECT {_KIND_SQL} || ':' || year(day) || '_' || month(day) || '_' || day(day) || ':' || loc AS obsnme,
 CASE WHEN value < 3 THEN -9999.0::double WHEN value < 6 THEN value / 10 ELSE value END AS obsval FROM daily""", ("daily",))

_cte("excluded", f"SELECT lpad(cast(s_suppkey AS varchar), 8, '0') AS loc FROM supplier WHERE {EXCLUDED}")

_cte("grouped_obs", """
SELECT obsnme, obsval, CASE
 WHEN obsnme LIKE 'streamflow_daily%' AND (obsval = -9999 OR split_part(obsnme, ':', 3) IN (SELECT loc FROM excluded)) THEN 'streamflow_nodata'
 WHEN obsnme LIKE 'streamflow_daily_1_2:%' THEN 'streamflow_daily_large_asc'
 WHEN obsnme LIKE 'streamflow_daily_4_1:%' THEN 'streamflow_daily_low'
 WHEN obsnme LIKE 'streamflow_daily_5_1:%' THEN 'streamflow_daily_exlow'
 WHEN obsnme LIKE 'streamflow_daily_-9999_-9999%' THEN 'streamflow_nodata'
 WHEN obsnme LIKE 'unknown%' THEN 'obgnme' ELSE split_part(obsnme, ':', 1) END AS obgnme FROM named_obs""",
     ("named_obs", "excluded"))


def grouped_obs(spark, d):
    gauges = read(spark, d, "supplier").where(EXCLUDED).select(
        F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("loc"))
    return O.assign_groups(named_obs(spark, d), gauges)


def noise_table(spark):
    rows = [(f"{g}   ", 0.1 if g.startswith("streamflow") else 0.001, 1e11, 0.1 if g.startswith("stream") else 0.2)
            for g in (*O.RANGE_GROUPS, *O.FLOW_GROUPS, *O.DAILY_FLOW_GROUPS.values(), O.NO_DATA_GROUP)]
    return spark.createDataFrame(rows, "obsgroup string, noise_percent double, obsubnd double, wt_percent double")


@check("P14_observation_groups", with_ctes("grouped_obs") + "SELECT obsnme, obsval, obgnme FROM grouped_obs")
def groups(spark, d):
    return grouped_obs(spark, d)


@check("P15_bounds_and_noise", with_ctes("grouped_obs") + f"""
SELECT obsnme, obsval, obgnme, CASE WHEN obgnme <> 'obgnme' THEN 1e11::double END AS upper_bound, 0.0::double AS lower_bound,
 {q_rnd("CASE WHEN obsval = -9999 THEN 9999 WHEN obgnme = 'obgnme' THEN NULL WHEN obgnme LIKE 'streamflow%' THEN 0.1 * obsval ELSE 0.001 * obsval END")} AS standard_deviation
FROM grouped_obs""")
def bounds(spark, d):
    return O.bounds_and_noise(grouped_obs(spark, d), noise_table(spark)).withColumn(
        "standard_deviation", rnd("standard_deviation"))


_WEIGHT = """CASE WHEN obsval = -9999 THEN 0 WHEN obgnme LIKE 'stream%' AND obsval <= 1 THEN 1 WHEN obgnme = 'streamflow_nodata' THEN 0
 WHEN obgnme LIKE 'streamflow%' THEN 10 / obsval WHEN obgnme LIKE '%sca_daily' THEN 10 WHEN obgnme = 'obgnme' THEN NULL ELSE 1 / 0.2 END"""


@check("P16_initial_weights", with_ctes("grouped_obs") + f"""
SELECT obsnme, obsval, obgnme, {q_rnd(_WEIGHT)} AS weight FROM grouped_obs""")
def weights(spark, d):
    return O.initial_weights(grouped_obs(spark, d), noise_table(spark)).withColumn("weight", rnd("weight"))


@check("P26_inequality_sense", with_ctes("residuals") + """
SELECT name, CASE WHEN weight = 0 THEN 'inactive' WHEN "group" LIKE 'g\\_%' ESCAPE '\\' THEN 'greater_than'
 WHEN "group" LIKE 'l\\_%' ESCAPE '\\' THEN 'less_than' ELSE 'two_sided' END AS sense FROM residuals""")
def senses(spark, d):
    return residuals(spark, d).select("name", inequality.sense(F.col("group"), F.col("weight")).alias("sense"))


@check("P27_nonzero_and_adjustable", with_ctes("residuals", "parameters") + """
SELECT 'nonzero' AS kind, count(*) AS n FROM residuals WHERE weight > 0
UNION ALL SELECT 'zero', count(*) FROM residuals WHERE weight = 0
UNION ALL SELECT 'adjustable', count(*) FROM parameters WHERE partrans NOT IN ('tied', 'fixed')
UNION ALL SELECT 'tied', count(*) FROM parameters WHERE partrans = 'tied'""")
def subsets(spark, d):
    from brookcal.operators import parameters as P

    res, par = residuals(spark, d), parameters(spark, d)
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return (
        count(O.nonzero(res), "nonzero").unionByName(count(O.zero_weighted(res), "zero"))
        .unionByName(count(P.adjustable(par), "adjustable")).unionByName(count(P.tied(par), "tied")))


@check("P28_group_lists", with_ctes("observations") + """
SELECT obgnme, max(weight) > 0 AS has_nonzero FROM observations GROUP BY obgnme""")
def group_lists(spark, d):
    obs = observations(spark, d)
    nz = O.groups(obs, nonzero_only=True).withColumn("has_nonzero", F.lit(True))
    return O.groups(obs).join(nz, "obgnme", "left").withColumn("has_nonzero", F.coalesce("has_nonzero", F.lit(False)))


@check("P29_subset_run", with_ctes("observations", "parameters") + """
, o AS (SELECT * FROM observations WHERE obsval > 0.05), p AS (SELECT * FROM parameters WHERE parval1 > 905)
SELECT 'obs' AS kind, count(*) AS n, count(DISTINCT obgnme) AS n_groups FROM o
UNION ALL SELECT 'par', count(*), count(DISTINCT pargp) FROM p""")
def subset(spark, d):
    obs, par = observations(spark, d), parameters(spark, d)
    out = O.subset_run(obs, par, obs.where("obsval > 0.05"), par.where("parval1 > 905"),
                       O.groups(obs), O.groups(par, group="pargp"))
    def size(kind, rows, groups):
        n = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        g = groups.agg(F.count(F.lit(1)).alias("n_groups")).withColumn("kind", F.lit(kind))
        return n.join(g, "kind")
    return size("obs", out["observations"], out["observation_groups"]).unionByName(
        size("par", out["parameters"], out["parameter_groups"]))


@check("P30_rename", with_ctes("residuals") + """
SELECT CASE WHEN "group" = 'flow_n' THEN 'renamed:' || name ELSE name END AS name, measured FROM residuals""")
def renamed(spark, d):
    res = residuals(spark, d)
    mapping = res.where(F.col("group") == "flow_n").select(
        F.col("name").alias("old"), F.concat(F.lit("renamed:"), "name").alias("new"))
    return O.rename(res, mapping, "name").select("name", "measured")


@check("P31_proportional_weights", with_ctes("residuals") + f"""
SELECT name, {q_sig('CASE WHEN weight = 0 THEN 0 WHEN measured = 0 THEN 0.001 ELSE least(0.001, 1 / (abs(measured) * 0.2)) END')} AS weight FROM residuals""")
def proportional(spark, d):
    obs = residuals(spark, d).withColumnRenamed("measured", "obsval")
    return O.proportional_weights(obs, 0.2, 0.001).select("name", sig("weight").alias("weight"))


@check("P32_weight_of_listed_zeros", with_ctes("residuals") + """
SELECT name AS obsnme, CASE WHEN "group" = 'l_max_a' AND weight = 0 THEN 5.0::double ELSE weight END AS weight FROM residuals""")
def listed_zero(spark, d):
    obs = residuals(spark, d).withColumnRenamed("name", "obsnme")
    listed = obs.where(F.col("group") == "l_max_a")
    return O.set_weight_of_listed_zeros(obs, listed, 5.0).select("obsnme", "weight")


@check("J3_aligned_assignment", with_ctes("observations", "ensemble") + f"""
SELECT o.obsnme, {q_rnd('coalesce(e.value, o.obsval)')} AS obsval FROM observations o
LEFT JOIN ensemble e ON e.name = o.obsnme AND e.real = 'base' AND o.weight > 1""")
def assignment(spark, d):
    from checks.views import ensemble

    obs = observations(spark, d)
    listed = obs.where("weight > 1").select("obsnme")
    values = ensemble(spark, d).where("real = 'base'").select(F.col("name").alias("obsnme"), F.col("value").alias("obsval"))
    return O.assign_values(obs, O.keep_names(values, listed), "obsnme", "obsval").select("obsnme", rnd("obsval").alias("obsval"))


@check("J8_range_zero_weight", with_ctes("daily") + """
SELECT loc, day, CASE WHEN s_acctbal < 5000 AND month(day) BETWEEN 3 AND 6 AND year(day) BETWEEN 1996 AND 1999
 OR s_acctbal < 2000 AND month(day) BETWEEN 5 AND 12 AND year(day) BETWEEN 1995 AND 1997 THEN 0.0::double ELSE 1.0::double END AS weight
FROM daily JOIN supplier ON lpad(cast(s_suppkey AS varchar), 8, '0') = loc""")
def range_zero(spark, d):
    obs = daily(spark, d).select(
        F.lit("streamflow").alias("group"), "loc", "day", F.year("day").alias("year"), F.month("day").alias("month"),
        F.lit(1.0).alias("weight"))
    sup = read(spark, d, "supplier")
    span = lambda cut, a, b, c, e: sup.where(F.col("s_acctbal") < cut).select(
        F.lit("streamflow").alias("group"), F.col("s_suppkey").alias("location"), F.lit(a).alias("stmonth"),
        F.lit(b).alias("endmonth"), F.lit(c).alias("styear"), F.lit(e).alias("endyear"))
    ranges = span(5000, 3, 6, 1996, 1999).unionByName(span(2000, 5, 12, 1995, 1997))
    return O.zero_weight_by_range(obs, ranges).select("loc", "day", "weight")


@check("U1_stacked_groups", with_ctes("daily") + f"""
SELECT 'flow_ann:' || year(day) || ':' || loc AS obsnme, {q_rnd('avg(value)')} AS obsval FROM daily GROUP BY loc, year(day)
UNION ALL SELECT 'flow_mon:' || year(day) || '_' || month(day) || ':' || loc, {q_rnd('avg(value)')} FROM daily GROUP BY loc, year(day), month(day)""")
def stacked(spark, d):
    from brookcal.functions import names
    from brookcal.operators import series

    df, p, loc = daily(spark, d), F.col("period"), F.col("loc")
    ann = series.annual_mean(df).select(names.build_name("flow_ann", F.year(p), loc).alias("obsnme"), rnd("value").alias("obsval"))
    mon = series.monthly_mean(df).select(names.build_name("flow_mon", names.month_period(p), loc).alias("obsnme"), rnd("value").alias("obsval"))
    return ann.unionByName(mon)


@check("U2_zero_weight_groups", with_ctes("observations") + """
SELECT obgnme FROM observations EXCEPT SELECT obgnme FROM observations WHERE weight > 0""")
def zero_groups(spark, d):
    return O.zero_weight_groups(observations(spark, d))


@check("A19_observation_summary", with_ctes("residuals") + f"""
SELECT "group" AS obgnme, count(CASE WHEN weight > 0 THEN 1 END) AS nonzero_count, count(CASE WHEN weight = 0 THEN 1 END) AS zero_count,
 min(measured) AS obsval_min, max(measured) AS obsval_max, min(weight) AS weight_min, max(weight) AS weight_max,
 {q_rnd('min(1 / nullif(weight, 0))')} AS stdev_min, {q_rnd('max(1 / nullif(weight, 0))')} AS stdev_max,
 {q_sig('min(100 / nullif(weight, 0) / abs(nullif(measured, 0)))')} AS pe_min, {q_sig('max(100 / nullif(weight, 0) / abs(nullif(measured, 0)))')} AS pe_max
FROM residuals GROUP BY 1""")
def obs_summary(spark, d):
    obs = residuals(spark, d).select(F.col("group").alias("obgnme"), F.col("measured").alias("obsval"), "weight")
    t = O.summary_table(obs)
    return t.select("obgnme", "nonzero_count", "zero_count", "obsval_min", "obsval_max", "weight_min", "weight_max",
                    *[rnd(c).alias(c) for c in ("stdev_min", "stdev_max")], *[sig(c).alias(c) for c in ("pe_min", "pe_max")])


@check("A29_null_checks", with_ctes("grouped_obs") + f"""
, w AS (SELECT obgnme, obsval, {_WEIGHT} AS weight FROM grouped_obs)
SELECT obgnme, count(*) AS n_rows, count(*) - count(weight) AS null_weights, count(*) - count(weight) AS rows_with_null,
 count(DISTINCT weight) AS distinct_weights FROM w GROUP BY 1""")
def nulls(spark, d):
    return O.null_checks(O.initial_weights(grouped_obs(spark, d), noise_table(spark)))
