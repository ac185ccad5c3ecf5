"""Inputs for which data worth, group conflict and noisy draws have a closed form that SQL can write down."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookcal.operators import data_worth as W
from brookcal.operators import ensembles as E
from brookcal.operators import sampling as D
from checks.registry import check, q_rnd, rnd
from checks.views import _cte, ensemble, observations, with_ctes

# every observation is a group of its own, so that each solve is a division
_cte("allcov", """
SELECT a.name AS x, b.name AS y, covar_samp(a.value, b.value) AS c, avg(b.value) AS m
FROM ensemble a JOIN ensemble b ON a.real = b.real GROUP BY 1, 2""", ("ensemble",))
_cte("noisy", "SELECT obsnme AS x, 0.01::double / (weight * weight) AS r FROM observations WHERE weight > 0", ("observations",))
_cte("forecast", "SELECT obsnme AS y FROM observations WHERE weight = 0", ("observations",))
_cte("single", """
SELECT g.x AS "group", p.y AS name, sqrt(pp.c) AS prior_std, sqrt(greatest(pp.c - gp.c * gp.c / (gg.c + g.r), 0)) AS post_std
FROM noisy g JOIN allcov gg ON gg.x = g.x AND gg.y = g.x JOIN allcov gp ON gp.x = g.x JOIN forecast p ON p.y = gp.y
JOIN allcov pp ON pp.x = p.y AND pp.y = p.y""", ("noisy", "allcov", "forecast"))


def _single_groups(spark, d):
    obs = observations(spark, d)
    used = obs.where("weight > 0")
    groups = used.select(F.col("obsnme").alias("group"), F.col("obsnme").alias("name"))
    noise = D.observation_variance(used).select("name", (F.col("var") * 0.01).alias("var"))
    return groups, noise, obs.where("weight = 0").select(F.col("obsnme").alias("name"))


@check("N9_single_observation_worth", with_ctes("single") + f"""
SELECT "group", name, {q_rnd('prior_std', 8)} AS prior_std, {q_rnd('post_std', 8)} AS post_std, {q_rnd('100 * (1 - post_std / prior_std)', 6)} AS percent_reduction FROM single""")
def single_worth(spark, d):
    std, _ = W.posterior_moments(ensemble(spark, d), *_single_groups(spark, d), first_moment=False)
    return std.where("group <> 'posterior'").select(
        "group", "name", rnd("prior_std", 8).alias("prior_std"), rnd("post_std", 8).alias("post_std"),
        rnd("percent_reduction", 6).alias("percent_reduction"))


@check("N9_single_observation_means", with_ctes("allcov", "noisy", "forecast") + f"""
SELECT g.x AS "group", p.y AS name, e.real, {q_rnd('gp.m + gp.c / (gg.c + g.r) * (e.value - gg.m)', 8)} AS mean
FROM noisy g JOIN allcov gg ON gg.x = g.x AND gg.y = g.x JOIN allcov gp ON gp.x = g.x JOIN forecast p ON p.y = gp.y JOIN ensemble e ON e.name = g.x""")
def single_means(spark, d):
    _, means = W.posterior_moments(ensemble(spark, d), *_single_groups(spark, d))
    return means.where("group <> 'posterior'").select("group", "name", "real", rnd("mean", 8).alias("mean"))


@check("N10_convergence_at_full_size", with_ctes("single") + f"""
SELECT 1000000000 AS size, "group", name, {q_rnd('post_std', 8)} AS post_std, 2 AS repeats FROM single""")
def converged(spark, d):
    """Subsets as large as the ensemble give its own worth, in every repeat."""
    t = W.convergence(ensemble(spark, d), *_single_groups(spark, d), [1_000_000_000], 2, seed=5)
    return t.where("group <> 'posterior'").withColumn("post_std", rnd("post_std", 8))


@check("W10_best_single_observations", with_ctes("single", recursive=False) + f"""
, s1 AS (SELECT "group", sum(post_std * post_std) AS v FROM single GROUP BY 1),
b1 AS (SELECT "group", v FROM s1 ORDER BY v, "group" LIMIT 1),
s2 AS (SELECT h.x AS "group", sum(greatest(pp.c - (gp.c * gp.c * (hh.c + h.r) - 2 * gp.c * hp.c * gh.c + hp.c * hp.c * (gg.c + g.r))
        / ((gg.c + g.r) * (hh.c + h.r) - gh.c * gh.c), 0)) AS v
 FROM b1 JOIN noisy g ON g.x = b1."group" JOIN noisy h ON h.x <> g.x JOIN allcov gg ON gg.x = g.x AND gg.y = g.x
 JOIN allcov hh ON hh.x = h.x AND hh.y = h.x JOIN allcov gh ON gh.x = g.x AND gh.y = h.x JOIN allcov gp ON gp.x = g.x
 JOIN forecast p ON p.y = gp.y JOIN allcov hp ON hp.x = h.x AND hp.y = p.y JOIN allcov pp ON pp.x = p.y AND pp.y = p.y GROUP BY 1),
b2 AS (SELECT "group", v FROM s2 ORDER BY v, "group" LIMIT 1)
SELECT 1 AS step, "group", {q_rnd('v', 8)} AS variance FROM b1 UNION ALL SELECT 2, "group", {q_rnd('v', 8)} FROM b2""")
def best_single(spark, d):
    """Two picks among single observations: a division, then a solve of two by two."""
    return W.best_additions(ensemble(spark, d), *_single_groups(spark, d), 2).withColumn("variance", rnd("variance", 8))


@check("N22_single_observation_conflict", with_ctes("ensemble", "observations") + f"""
, e AS (SELECT name, real, value, obsval, count(*) OVER n AS ne, sum(value) OVER n AS s, sum(value * value) OVER n AS ss, var_samp(value) OVER n AS v
 FROM ensemble JOIN observations ON obsnme = name WHERE weight > 0 WINDOW n AS (PARTITION BY name)),
c AS (SELECT *, 2.0::double / (ne + 1) AS delta, (s - value) / (ne - 1) AS mu, ss - value * value AS rest FROM e),
k AS (SELECT *, delta * v * (ne - 2) / (1 - delta) AS ridge FROM c),
x AS (SELECT name, ne, (value - mu) ** 2 * ridge / (ridge + rest) / (delta * v) AS dx, (obsval - mu) ** 2 * ridge / (ridge + rest) / (delta * v) AS dz FROM k),
m AS (SELECT name, median(dx) AS mx, median(dz) AS mz FROM x GROUP BY 1),
a AS (SELECT name, median(abs(dx - mx)) AS mad FROM x JOIN m USING (name) GROUP BY 1),
o AS (SELECT name, ne, row_number() OVER (PARTITION BY name ORDER BY dx) - 1 AS place, abs(dx - mz) AS off FROM x JOIN m USING (name)),
p AS (SELECT name, 1 - arg_min(place, off) / max(ne) AS p_value FROM o GROUP BY 1)
SELECT name AS obgnme, {q_rnd('(mz - mx) / (1.4826 * mad)')} AS z_score, {q_rnd('p_value')} AS p_value FROM m JOIN a USING (name) JOIN p USING (name)""")
def single_conflict(spark, d):
    obs = observations(spark, d).withColumn("obgnme", F.col("obsnme"))
    return W.group_conflict(ensemble(spark, d), obs).select("obgnme", rnd("z_score").alias("z_score"), rnd("p_value").alias("p_value"))


@check("N20_conflict_distance_with_known_noise", with_ctes("ensemble", "observations") + f"""
, s AS (SELECT name, avg(value + value * value) AS m, var_samp(value + value * value) AS v FROM ensemble GROUP BY 1)
SELECT name, {q_rnd('(m - obsval) ** 2 / v')} AS sq_distance FROM s JOIN observations ON obsnme = name WHERE weight > 0 AND (m - obsval) ** 2 / v > 0""")
def known_noise(spark, d):
    reals = ensemble(spark, d)
    noise = reals.withColumn("value", F.col("value") * F.col("value"))
    t = E.conflict_distance(reals, observations(spark, d), critical=0.0, noise=noise)
    return t.withColumn("sq_distance", rnd("sq_distance"))


@check("W11_sample_properties", with_ctes("ensemble") + """
SELECT least(25, count(DISTINCT real)) AS n, least(25, count(DISTINCT real)) AS n_distinct, true AS known, true AS repeatable FROM ensemble""")
def sample_properties(spark, d):
    """Distinct ids of the ensemble, the same whatever the partitions."""
    reals = ensemble(spark, d)
    one = E.sample_realizations(reals, 25, seed=7)
    other = E.sample_realizations(reals.repartition(7, "name"), 25, seed=7).withColumn("again", F.lit(True))
    ids = reals.select("real").distinct().withColumn("there", F.lit(True))
    found = one.join(other, "real", "full").join(ids, "real", "left")
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("real").alias("n_distinct"),
        F.bool_and(F.coalesce("there", F.lit(False))).alias("known"), F.bool_and(F.coalesce("again", F.lit(False))).alias("repeatable"))
