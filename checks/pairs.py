from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brookcal.functions.ordering import global_row_number
from brookcal.functions.variograms import Structure, Variogram
from brookcal.operators import data_worth as W
from brookcal.operators import pairs as X
from brookcal.operators import sampling as D
from brookcal.operators.noise import noise_draw
from brookcal.session import spread_rows
from checks.registry import check, q_rnd, q_sig, rnd, sig
from checks.views import _cte, ensemble, observations, read, with_ctes

_cte("dev", "SELECT real, name, value - avg(value) OVER (PARTITION BY name) AS d FROM ensemble", ("ensemble",))
_cte("cov", """
SELECT a.name AS row, b.name AS col, sum(a.d * b.d) / ((SELECT count(DISTINCT real) FROM ensemble) - 1) AS v
FROM dev a JOIN dev b ON a.real = b.real AND a.name <= b.name GROUP BY 1, 2""", ("dev",))


def jacobian(spark, d):
    line = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    entries = line.join(part, "l_partkey").groupBy(
        F.col("l_suppkey").cast("string").alias("obs"), F.col("p_brand").alias("par")).agg((F.sum("l_quantity") / 100).alias("v"))
    # steps with several copies of it would read as many merged partitions in one task
    return spread_rows(entries, line.count(), "obs", "par")


_cte("jac", """
SELECT cast(l_suppkey AS varchar) AS obs, p_brand AS par, sum(l_quantity) / 100 AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
_cte("jobs", "SELECT cast(s_suppkey AS varchar) AS obs, s_suppkey % 3 * 0.5::double AS weight FROM supplier")


def jac_obs(spark, d):
    return read(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("obsnme"), (F.col("s_suppkey") % 3 * 0.5).alias("weight"))


@check("N5_covariance", with_ctes("cov") + f"SELECT row, col, {q_rnd('v', 9)} AS v FROM cov")
def covariance(spark, d):
    return X.covariance(ensemble(spark, d)).withColumn("v", rnd("v", 9))


@check("N5_covariance_localised", with_ctes("cov", "observations") + f"""
SELECT row, col, {q_rnd('v * (CASE WHEN row = col THEN 1.0 ELSE 0.5 END)', 9)} AS v FROM cov
JOIN observations a ON a.obsnme = row JOIN observations b ON b.obsnme = col WHERE a.obgnme = b.obgnme""")
def localised(spark, d):
    obs = observations(spark, d).select("obgnme", "obsnme")
    loc = obs.withColumnRenamed("obsnme", "row").join(obs.withColumnRenamed("obsnme", "col"), "obgnme").select(
        "row", "col", F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.5).alias("v"))
    return X.covariance(ensemble(spark, d), localizer=loc).withColumn("v", rnd("v", 9))


@check("N5_covariance_in_groups", with_ctes("cov", "observations") + f"""
SELECT a.obgnme AS grp, row, col, {q_rnd('v', 9)} AS v FROM cov JOIN observations a ON a.obsnme = row JOIN observations b ON b.obsnme = col WHERE a.obgnme = b.obgnme""")
def grouped(spark, d):
    obs = observations(spark, d).select(F.col("obsnme").alias("name"), F.col("obgnme").alias("grp"))
    return X.covariance(ensemble(spark, d).join(obs, "name"), keys=["grp"]).withColumn("v", rnd("v", 9))


@check("N5_covariance_about_base", with_ctes("ensemble") + f"""
, d AS (SELECT e.real, e.name, e.value - b.value AS d FROM ensemble e JOIN ensemble b ON b.name = e.name AND b.real = 'base')
SELECT a.name AS row, b.name AS col, {q_rnd('sum(a.d * b.d) / ((SELECT count(DISTINCT real) FROM d) - 1)', 9)} AS v FROM d a JOIN d b ON a.real = b.real AND a.name <= b.name GROUP BY 1, 2""")
def centred(spark, d):
    return X.covariance(ensemble(spark, d), center_on="base").withColumn("v", rnd("v", 9))


@check("N6_pearson", with_ctes("ensemble") + f"""
SELECT a.name AS row, b.name AS col, {q_rnd('corr(a.value, b.value)', 8)} AS v FROM ensemble a JOIN ensemble b ON a.real = b.real AND a.name <= b.name GROUP BY 1, 2""")
def correlation(spark, d):
    return X.pearson(X.covariance(ensemble(spark, d))).withColumn("v", rnd("v", 8))


@check("N7_correlation_equations", with_ctes("ensemble") + f"""
SELECT 'pcc_' || a.name || '_' || b.name AS pilbl, '1.0 * log(' || a.name || ') - 1.0 * log(' || b.name || ') = 0.0' AS equation, {q_rnd('corr(a.value, b.value)', 8)} AS weight,
 'regul_cc' AS obgnme FROM ensemble a JOIN ensemble b ON a.real = b.real AND a.name < b.name GROUP BY a.name, b.name HAVING corr(a.value, b.value) >= 0.02""")
def ties(spark, d):
    pars = observations(spark, d).select(F.col("obsnme").alias("parnme"), F.lit("log").alias("partrans"))
    return X.correlation_equations(X.covariance(ensemble(spark, d)), pars, 0.02).withColumn("weight", rnd("weight", 8))


@check("N7_ties_from_ensemble", with_ctes("ensemble") + f"""
SELECT 'pcc_' || a.name || '_' || b.name AS pilbl, {q_rnd('corr(a.value, b.value)', 8)} AS weight
FROM ensemble a JOIN ensemble b ON a.real = b.real AND a.name < b.name GROUP BY a.name, b.name HAVING corr(a.value, b.value) >= 0.05""")
def ties_from_ensemble(spark, d):
    pars = observations(spark, d).select(F.col("obsnme").alias("parnme"), F.lit("none").alias("partrans"))
    return X.tie_equations(X.correlated_pairs(ensemble(spark, d), 0.05), pars).select("pilbl", rnd("weight", 8).alias("weight"))


@check("N21_pair_conflict", with_ctes("cov", "observations") + f"""
, f AS (SELECT name, avg(value) - max(obsval) * 4 AS r, var_samp(value) AS v, max(weight) AS w FROM ensemble JOIN observations ON obsnme = name GROUP BY 1),
p AS (SELECT row AS obsnme_1, col AS obsnme_2, (a.r * a.r * b.v + b.r * b.r * a.v - 2 * a.r * b.r * c.v) / (a.v * b.v - c.v * c.v) AS sq
 FROM cov c JOIN f a ON a.name = row JOIN f b ON b.name = col WHERE row < col AND a.w > 0 AND b.w > 0)
SELECT obsnme_1, obsnme_2, {q_rnd('sq')} AS sq_distance FROM p WHERE sq > 5""")
def pair_conflict(spark, d):
    obs = observations(spark, d).withColumn("obsval", F.col("obsval") * 4)
    return X.pair_conflict(ensemble(spark, d), obs, 5.0).withColumn("sq_distance", rnd("sq_distance"))


@check("A26_composite_parameter_sensitivity", with_ctes("jac", "jobs") + f"""
, n AS (SELECT count(*) AS nnz FROM jobs WHERE weight > 0), p AS (SELECT p_brand AS par, min(p_retailprice) AS x FROM part GROUP BY 1)
SELECT jac.par, {q_sig('sqrt(sum((v * weight) ** 2)) / max(nnz)')} AS unscaled_css, {q_sig('sqrt(sum((v * weight) ** 2)) * max(log10(x)) / max(nnz) ** 2')} AS css
FROM jac JOIN jobs ON jobs.obs = jac.obs JOIN p ON p.par = jac.par, n GROUP BY 1""")
def css(spark, d):
    pars = read(spark, d, "part").groupBy(F.col("p_brand").alias("parnme")).agg(F.min("p_retailprice").alias("parval1")).select(
        "*", F.lit("log").alias("partrans"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"))
    t = X.composite_parameter_sensitivity(jacobian(spark, d), jac_obs(spark, d), pars)
    return t.select("par", sig("unscaled_css").alias("unscaled_css"), sig("css").alias("css"))


@check("A27_composite_observation_sensitivity", with_ctes("jac", "jobs") + f"""
SELECT jac.obs, {q_sig('sqrt(sum((v * weight) ** 2)) / ((SELECT count(DISTINCT par) FROM jac) - 1)')} AS cso FROM jac JOIN jobs ON jobs.obs = jac.obs GROUP BY 1""")
def cso(spark, d):
    return X.composite_observation_sensitivity(jacobian(spark, d), jac_obs(spark, d)).withColumn("cso", sig("cso"))


@check("N23_observation_competition", with_ctes("jac", "jobs") + f"""
, q AS (SELECT jac.obs, par, v * weight AS v FROM jac JOIN jobs ON jobs.obs = jac.obs WHERE weight > 0)
SELECT a.obs AS row, b.obs AS col, {q_sig('CASE WHEN a.obs = b.obs THEN 0 ELSE sum(a.v * b.v) END')} AS v FROM q a JOIN q b ON a.par = b.par AND a.obs <= b.obs GROUP BY a.obs, b.obs""")
def competition(spark, d):
    return X.observation_competition(jacobian(spark, d), jac_obs(spark, d)).withColumn("v", sig("v"))


@check("N23_strong_competition", with_ctes("jac", "jobs") + f"""
, q AS (SELECT jac.obs, par, v * weight AS v FROM jac JOIN jobs ON jobs.obs = jac.obs WHERE weight > 0)
SELECT a.obs AS row, b.obs AS col, {q_sig('sum(a.v * b.v)')} AS v FROM q a JOIN q b ON a.par = b.par AND a.obs < b.obs GROUP BY a.obs, b.obs HAVING abs(sum(a.v * b.v)) >= 1000""")
def strong_competition(spark, d):
    return X.observation_competition(jacobian(spark, d), jac_obs(spark, d), 1000.0).withColumn("v", sig("v"))


def _a(spark, d):
    return jacobian(spark, d).select(F.col("obs").alias("row"), F.col("par").alias("col"), "v")


def _b(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("row"), F.col("p_type").alias("col")).agg(
        F.sum("p_size").cast("double").alias("v"))


_cte("ma", "SELECT obs AS row, par AS col, v FROM jac", ("jac",))
_cte("mb", "SELECT p_brand AS row, p_type AS col, cast(sum(p_size) AS double) AS v FROM part GROUP BY 1, 2")


@check("N25_product", with_ctes("ma", "mb") + f"SELECT ma.row, mb.col, {q_sig('sum(ma.v * mb.v)')} AS v FROM ma JOIN mb ON ma.col = mb.row GROUP BY 1, 2")
def product(spark, d):
    return X.multiply(_a(spark, d), _b(spark, d)).withColumn("v", sig("v"))


@check("N25_sum_and_difference", with_ctes("ma") + f"""
, h AS (SELECT row, col, v * 0.25 AS v FROM ma WHERE v > 3)
SELECT 'sum' AS op, row, col, {q_sig('sum(v)')} AS v FROM (SELECT * FROM ma UNION ALL SELECT * FROM h) GROUP BY row, col
UNION ALL SELECT 'difference', row, col, {q_sig('sum(v)')} FROM (SELECT * FROM ma UNION ALL SELECT row, col, -v FROM h) GROUP BY row, col""")
def sums(spark, d):
    a = _a(spark, d)
    h = a.where("v > 3").withColumn("v", F.col("v") * 0.25)
    t = X.add(a, h).withColumn("op", F.lit("sum")).unionByName(X.add(a, h, -1.0).withColumn("op", F.lit("difference")))
    return t.withColumn("v", sig("v"))


@check("N25_hadamard_and_transpose", with_ctes("ma") + f"SELECT col AS row, row AS col, {q_sig('v * v * 0.25')} AS v FROM ma WHERE v > 3")
def elementwise(spark, d):
    a = _a(spark, d)
    h = a.where("v > 3").withColumn("v", F.col("v") * 0.25)
    return X.transpose(X.hadamard(a, h)).withColumn("v", sig("v"))


@check("N25_select_drop_extract", with_ctes("ma", "jobs") + f"""
SELECT 'taken' AS part, row, col, {q_sig('v')} AS v FROM ma WHERE row IN (SELECT obs FROM jobs WHERE weight > 0) AND col <> 'Brand#1'
UNION ALL SELECT 'left', row, col, {q_sig('v')} FROM ma WHERE row NOT IN (SELECT obs FROM jobs WHERE weight > 0) AND col = 'Brand#1'""")
def pick(spark, d):
    a = _a(spark, d)
    rows = jac_obs(spark, d).where("weight > 0").select(F.col("obsnme").alias("name"))
    cols = read(spark, d, "part").where("p_brand <> 'Brand#1'").select(F.col("p_brand").alias("name")).distinct()
    taken, left = X.extract(a, rows, cols)
    return taken.withColumn("part", F.lit("taken")).unionByName(left.withColumn("part", F.lit("left"))).withColumn("v", sig("v"))


@check("N25_extend_diagonal_replace", with_ctes("cov") + f"""
SELECT row AS name, {q_sig('CASE WHEN v > 0.015 THEN 1.0 ELSE v END')} AS v FROM cov WHERE row = col
UNION ALL SELECT 'x' || row, {q_sig('v * 2')} FROM cov WHERE row = col""")
def blocks(spark, d):
    cov = X.covariance(ensemble(spark, d))
    other = cov.select(F.concat(F.lit("x"), "row").alias("row"), F.concat(F.lit("x"), "col").alias("col"), (F.col("v") * 2).alias("v"))
    big = cov.where("row = col AND v > 0.015").withColumn("v", F.lit(1.0))
    return X.diagonal(X.replace_entries(X.extend(cov, other), big)).withColumn("v", sig("v"))


@check("U4_common_names", with_ctes("ma", "mb") + "SELECT DISTINCT col AS name FROM ma WHERE v > 5 INTERSECT SELECT row FROM mb WHERE v > 10")
def common(spark, d):
    return _a(spark, d).where("v > 5").select(F.col("col").alias("name")).intersect(
        _b(spark, d).where("v > 10").select(F.col("row").alias("name")))


@check("N14_correlated_draw", with_ctes("observations") + "SELECT obsnme AS name, 2000 AS n, true AS mean_ok, true AS std_ok FROM observations")
def correlated(spark, d):
    obs = observations(spark, d).select(F.col("obsnme").alias("name"), F.col("obgnme").alias("group"), F.col("obsval").alias("mean"))
    cov = X.covariance(ensemble(spark, d).join(obs.select("name", "group"), "name"), keys=["group"])
    draws = D.correlated_draw(cov, obs.select("name", "mean"), 2000, seed=17)
    std = ensemble(spark, d).groupBy("name").agg(F.stddev_samp("value").alias("std"))
    m = draws.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("a"), F.stddev_samp("value").alias("s"))
    err = F.col("std") / 2000**0.5
    return m.join(obs, "name").join(std, "name").select(
        "name", F.col("n").cast("int").alias("n"), (F.abs(F.col("a") - F.col("mean")) < 6 * err).alias("mean_ok"),
        (F.abs(F.col("s") - F.col("std")) < 6 * err).alias("std_ok"))


@check("N14_correlated_draw_pairs", with_ctes("observations") + """
SELECT a.obsnme AS "row", b.obsnme AS "col", true AS cov_ok FROM observations a JOIN observations b ON a.obgnme = b.obgnme AND a.obsnme <= b.obsnme""")
def correlated_pairs(spark, d):
    """The covariance of the draws against the table they were drawn from, pair by pair; independent draws fail here."""
    n = 2000
    obs = observations(spark, d).select(F.col("obsnme").alias("name"), F.col("obgnme").alias("group"), F.col("obsval").alias("mean"))
    cov = X.covariance(ensemble(spark, d).join(obs.select("name", "group"), "name"), keys=["group"])
    draws = D.correlated_draw(cov, obs.select("name", "mean"), n, seed=17)
    got = X.covariance(draws.join(obs.select("name", "group"), "name"), keys=["group"]).select("row", "col", F.col("v").alias("got"))
    var = X.diagonal(cov)
    side = lambda c: var.select(F.col("name").alias(c), F.col("v").alias(f"_{c}"))
    err = F.sqrt((F.col("_row") * F.col("_col") + F.col("v") * F.col("v")) / n)
    return cov.join(got, ["row", "col"], "left").join(side("row"), "row").join(side("col"), "col").select(
        "row", "col", F.coalesce(F.abs(F.col("got") - F.col("v")) < 6 * err, F.lit(False)).alias("cov_ok"))


NOISE = Structure((Variogram("exponential", 0.7, 400.0), Variogram("exponential", 0.2, 30.0)), 0.1)
_NOISE_OBS = """WITH o AS (SELECT c_name AS obsnme, CASE c_mktsegment WHEN 'BUILDING' THEN 'less_' ELSE '' END || c_mktsegment AS obgnme, c_acctbal AS obsval,
  c_nationkey % 5 <> 4 AS weighed, c_mktsegment AS series, floor(c_acctbal / 7) AS t FROM customer)"""


def _noise_obs(spark, d):
    """Customers as observations: balance, a market segment is a series, time rises with the balance; some have no weight."""
    c = read(spark, d, "customer")
    group = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", F.lit("less_")).otherwise(F.lit("")), F.col("c_mktsegment"))
    weight = F.when(F.col("c_nationkey") % 5 == 4, F.lit(0.0)).otherwise(F.lit(1.0) / (1 + F.col("c_nationkey") % 3))
    return c.select(
        F.col("c_name").alias("obsnme"), group.alias("obgnme"), F.col("c_acctbal").cast("double").alias("obsval"), weight.alias("weight"),
        F.lit(0.0).alias("lower_bound"), F.col("c_mktsegment").alias("series"), F.floor(F.col("c_acctbal") / 7).cast("double").alias("t"))


@check("N14_noise_draw", _NOISE_OBS + """
SELECT obsnme AS name, 400 AS n, NOT weighed OR series = 'BUILDING' AS kept, true AS mean_ok, true AS std_ok FROM o""")
def noise_moments(spark, d):
    """Each observation's draws have its value as mean and its deviation; those without weight and one-sided ones keep the value."""
    n, obs = 400, _noise_obs(spark, d)
    series = obs.where("weight != 0").select("obsnme", "series", "t")
    draws = noise_draw(obs, series, NOISE, n, seed=41)
    m = draws.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("a"), F.stddev_samp("value").alias("s"), F.max(F.abs("value")).alias("far"))
    j = m.join(obs, F.col("name") == F.col("obsnme"))
    kept, std = (F.col("s") == 0) & (F.abs(F.col("a") - F.col("obsval")) < 1e-6), F.try_divide(F.lit(1.0), F.col("weight"))
    fixed = (F.col("weight") == 0) | F.col("obgnme").startswith("less_")
    ok = lambda c, want, err: fixed | F.coalesce(F.abs(F.col(c) - want) < 6 * err, F.lit(False))
    return j.select(
        "name", F.col("n").cast("int").alias("n"), kept.alias("kept"), ok("a", F.col("obsval"), std / n**0.5).alias("mean_ok"),
        ok("s", std, std / (2 * n) ** 0.5).alias("std_ok"))


@check("N14_noise_draw_pairs", _NOISE_OBS + """
SELECT obsnme AS "row", lead(obsnme, k) OVER (PARTITION BY series ORDER BY t, obsnme) AS "col", k, true AS cov_ok
FROM (SELECT * FROM o WHERE weighed), (VALUES (1), (3), (12)) AS s(k)
QUALIFY lead(obsnme, k) OVER (PARTITION BY series, k ORDER BY t, obsnme) IS NOT NULL""".replace("OVER (PARTITION BY series ORDER", "OVER (PARTITION BY series, k ORDER"))
def noise_pairs(spark, d):
    """Covariance of observations that are 1, 3 and 12 apart in their series; independent draws fail here."""
    n, obs = 400, _noise_obs(spark, d).where("weight != 0")
    draws = noise_draw(obs, obs.select("obsnme", "series", "t"), NOISE, n, seed=43, draw_one_sided=True)
    packed = draws.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("real").cast("int").alias("i"), "value"))), lambda x: x["value"]).alias("z"))
    # places along all series are numbered without the draws; these then meet in blocks of places, each with the first of the next
    reach, block = 12, 256
    named = obs.select(F.col("obsnme").alias("name"), "series", "t", "obsval", "weight").where(F.col("name").isNotNull())
    at, own = F.col("_at") - 1, F.floor((F.col("_at") - 1) / block)
    rows = packed.join(global_row_number(named, ["series", "t", "name"], "_at"), "name").select(
        "name", "series", "t", "_at", F.transform("z", lambda x: (x - F.col("obsval")) * F.col("weight")).alias("z"), own.alias("_own"),
        F.explode(F.when(at % block < reach, F.array(own, own - 1)).otherwise(F.array(own))).alias("_block"))
    order = Window.partitionBy("series", "_block").orderBy("_at")
    ks = (1, 3, reach)
    near = rows.select("name", "t", "z", "_own", "_block", *[F.lead(F.struct("name", "t", "z"), k).over(order).alias(f"_{k}") for k in ks]).where("_own = _block")

    def tested(k):
        other = F.col(f"_{k}")
        want = sum((F.lit(v.contribution) * F.exp(-(other["t"] - F.col("t")) / v.a) for v in NOISE.variograms), F.lit(0.0))
        got = F.aggregate(F.zip_with("z", other["z"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / n
        return F.struct(other["name"].alias("col"), F.lit(k).alias("k"), (F.abs(got - want) < 6 * F.sqrt((1 + want * want) / n)).alias("cov_ok"))

    return near.select(F.col("name").alias("row"), F.explode(F.array(*map(tested, ks))).alias("p")).select("row", "p.*").where(F.col("col").isNotNull())


@check("N14_ensemble_based_draw", with_ctes("observations") + "SELECT obsnme AS name, 1000 AS n, true AS mean_ok, true AS std_ok FROM observations")
def from_ensemble(spark, d):
    en = ensemble(spark, d)
    draws = D.ensemble_based_draw(en, 1000, seed=23)
    want = en.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    m = draws.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("a"), F.stddev_samp("value").alias("s"))
    err = F.col("std") / 1000**0.5
    return m.join(want, "name").select(
        "name", F.col("n").cast("int").alias("n"), (F.abs(F.col("a") - F.col("mean")) < 6 * err).alias("mean_ok"),
        (F.abs(F.col("s") - F.col("std")) < 6 * err).alias("std_ok"))


def _worth_inputs(spark, d):
    obs = observations(spark, d)
    groups = obs.where("weight > 0").select(F.col("obgnme").alias("group"), F.col("obsnme").alias("name"))
    noise = D.observation_variance(obs.where("weight > 0")).select("name", (F.col("var") * 0.01).alias("var"))
    predictions = obs.where("weight = 0").select(F.col("obsnme").alias("name"))
    return groups, noise, predictions


@check("N9_data_worth")
def worth(spark, d):
    groups, noise, predictions = _worth_inputs(spark, d)
    std, _ = W.posterior_moments(ensemble(spark, d), groups, noise, predictions, first_moment=False)
    return std.select("group", "name", *[rnd(c, 8).alias(c) for c in ("prior_std", "post_std", "percent_reduction")])


@check("N9_posterior_means")
def worth_means(spark, d):
    groups, noise, predictions = _worth_inputs(spark, d)
    _, means = W.posterior_moments(ensemble(spark, d), groups, noise, predictions)
    return means.select("group", "real", "name", rnd("mean", 8).alias("mean"))


@check("N10_data_worth_convergence")
def converge(spark, d):
    groups, noise, predictions = _worth_inputs(spark, d)
    t = W.convergence(ensemble(spark, d), groups, noise, predictions, [20, 60], 2, seed=5)
    return t.withColumn("post_std", rnd("post_std", 8))


@check("W10_sequential_best_groups")
def best(spark, d):
    groups, noise, predictions = _worth_inputs(spark, d)
    return W.best_additions(ensemble(spark, d), groups, noise, predictions, 2).withColumn("variance", rnd("variance", 8))


@check("N22_group_conflict")
def group_conflict(spark, d):
    return W.group_conflict(ensemble(spark, d), observations(spark, d)).select(
        "obgnme", rnd("z_score").alias("z_score"), rnd("p_value").alias("p_value"))
