from __future__ import annotations

from pyspark.sql import functions as F

from brookcal.functions.variograms import Structure, Variogram, covariance
from brookcal.operators import sampling as D
from brookcal.operators import spatial as G
from checks.registry import check, q_rnd, q_sig, rnd, sig
from checks.views import _cte, ensemble, points, read, with_ctes

NESTED = Structure((Variogram("exponential", 1.5, 120.0), Variogram("gaussian", 0.5, 60.0, 2.0, 30.0), Variogram("spherical", 2.0, 90.0)), 0.1)
BALL = Structure((Variogram("spherical", 2.0, 40.0),), 0.25)


def targets(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(
        F.col("s_name").alias("target"), (k % 31 * 11.0 + 3.3).alias("x"), (k % 17 * 29.0 + 1.7).alias("y"), (F.col("s_nationkey") % 3 + 1).alias("zone"))


_cte("targets", """
SELECT s_name AS target, s_suppkey % 31 * 11.0::double + 3.3::double AS x, s_suppkey % 17 * 29.0::double + 1.7::double AS y, s_nationkey % 3 + 1 AS zone FROM supplier""")

_H = "sqrt(dx * dx + dy * dy)"
_HA = "sqrt((dx * cos(radians(60)) + dy * sin(radians(60))) ** 2 + (2 * (dy * cos(radians(60)) - dx * sin(radians(60)))) ** 2)"
_NESTED = f"""1.5 * exp(-{_H} / 120) + 0.5 * exp(-1 * ({_HA} / 60) ** 2) + CASE WHEN {_H} > 90 THEN 0 ELSE 2.0 * (1 - 1.5 * ({_H} / 90) + 0.5 * ({_H} / 90) ** 3) END"""
_BALL = f"CASE WHEN {_H} > 40 THEN 0 ELSE 2.0 * (1 - 1.5 * ({_H} / 40) + 0.5 * ({_H} / 40) ** 3) END"


@check("G1_variogram", with_ctes("points") + f"SELECT name, {q_rnd(_NESTED)} AS v FROM (SELECT name, x - 100 AS dx, y - 200 AS dy FROM points)")
def variogram(spark, d):
    return points(spark, d).select("name", rnd(covariance(NESTED, F.col("x") - 100, F.col("y") - 200)).alias("v"))


@check("G2_point_covariance", with_ctes("points") + f"""
SELECT zone, a AS row, b AS col, {q_rnd('v')} AS v FROM (SELECT p.zone, p.name AS a, q.name AS b, CASE WHEN p.name = q.name THEN 2.25 ELSE {_BALL.replace('dx', '(p.x - q.x)').replace('dy', '(p.y - q.y)')} END AS v
 FROM points p JOIN points q ON p.zone = q.zone AND p.name <= q.name) WHERE abs(v) > 1e-9""")
def point_cov(spark, d):
    return G.point_covariance(points(spark, d), BALL, ["zone"]).where(F.abs("v") > 1e-9).withColumn("v", rnd("v"))


@check("G2_dense_point_covariance", with_ctes("targets") + f"""
SELECT p.target AS row, q.target AS col, {q_rnd("CASE WHEN p.target = q.target THEN 4.0 ELSE " + _NESTED.replace('dx', '(p.x - q.x)').replace('dy', '(p.y - q.y)') + " END + 0.1")} AS v
FROM targets p JOIN targets q ON p.target <= q.target""")
def dense_cov(spark, d):
    t = targets(spark, d).withColumnRenamed("target", "name")
    return G.point_covariance(t, NESTED, nugget_everywhere=True, full=True).withColumn("v", rnd("v"))


@check("J14_near_duplicates", with_ctes("points") + """
SELECT DISTINCT q.name FROM points p JOIN points q ON p.name < q.name AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 < 25 * 25""")
def duplicates(spark, d):
    return G.near_duplicates(points(spark, d), 25.0)


@check("J15_nearest_points", with_ctes("points", "targets") + f"""
SELECT target, name, {q_rnd('dist')} AS distance, cast(rk AS integer) AS rank FROM (SELECT target, name, dist, row_number() OVER (PARTITION BY target ORDER BY dist, name) AS rk FROM
 (SELECT t.target, p.name, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) AS dist FROM targets t JOIN points p ON p.zone = t.zone) WHERE dist <= 60) WHERE rk <= 5""")
def nearest(spark, d):
    t = G.nearest_points(targets(spark, d), points(spark, d), 60.0, 5, ["zone"])
    return t.select("target", "name", rnd("distance").alias("distance"), "rank")


def _factors(spark, d):
    pts = points(spark, d)
    return G.kriging_weights(targets(spark, d), pts, BALL, 80.0, 6, 2, ["zone"])


@check("G3_kriging_weights")
def kriging(spark, d):
    w, _ = _factors(spark, d)
    return w.withColumn("w", rnd("w"))


@check("G3_kriging_error_variance")
def kriging_error(spark, d):
    _, err = _factors(spark, d)
    return err.withColumn("err_var", rnd("err_var"))


@check("G3_kriging_unbiased", with_ctes("points", "targets") + """
SELECT target, n >= 2 AS has_weights FROM (SELECT t.target, count(p.name) AS n FROM targets t LEFT JOIN points p ON p.zone = t.zone
 AND sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) <= 80 GROUP BY 1)""")
def unbiased(spark, d):
    """Weights of every target with enough points sum to 1 after dropping negative ones."""
    w, err = _factors(spark, d)
    s = w.groupBy("target").agg(F.sum("w").alias("s"), F.min("w").alias("lo"))
    return err.join(s, "target", "left").select("target", F.coalesce((F.abs(F.col("s") - 1) < 1e-9) & (F.col("lo") > 0), F.lit(False)).alias("has_weights"))


@check("G4_apply_weights", with_ctes("points", "targets") + f"""
, w AS (SELECT t.target, p.name, abs(p.value) + 1 AS value, 1.0 / rank() OVER (PARTITION BY t.target ORDER BY p.name) AS w FROM targets t JOIN points p ON p.zone = t.zone AND abs(p.x - t.x) < 20 AND abs(p.y - t.y) < 20),
n AS (SELECT target, pow(10, sum(w / s * log10(value))) AS v FROM (SELECT *, sum(w) OVER (PARTITION BY target) AS s FROM w) GROUP BY 1)
SELECT target, {q_sig('greatest(least(coalesce(v, 1e30), 5000), 10)')} AS value FROM targets LEFT JOIN n USING (target)""")
def apply_factors(spark, d):
    t, p = targets(spark, d), points(spark, d)
    vals = p.select("name", (F.abs("value") + 1).alias("value"))
    # pairs are many times the points: values and ranks come to them before they are formed, and weights are summed as they come
    valued = G.with_summand(p.drop("value"), vals, log=True)
    near = G.within_box(t.select("target", "zone", F.col("x").alias("tx"), F.col("y").alias("ty")), valued, 20.0, ["zone"], order="name", values="_v")
    w = near.select("target", (F.lit(1.0) / F.col("rank")).alias("w"), "_v")
    return G.apply_weights(w, None, t, log=True, lower=10.0, upper=5000.0, relative=True).withColumn("value", sig("value"))


@check("G5_cell_of_point", with_ctes("points") + f"""
SELECT name, cast(greatest(least(ceil((-20 + 24 * 25 - y) / 25) - 1, 23), 0) AS integer) AS row, cast(greatest(least(ceil((x + 10) / 20) - 1, 17), 0) AS integer) AS col,
 {q_rnd('-10 + (greatest(least(ceil((x + 10) / 20) - 1, 17), 0) + 0.5) * 20')} AS cx FROM points""")
def cell(spark, d):
    row, col = G.cell_of_point(F.col("x"), F.col("y"), 20.0, 25.0, 24, 18, -10.0, -20.0)
    t = points(spark, d).select("name", row.alias("row"), col.alias("col"))
    cx, _ = G.cell_centre(F.col("row"), F.col("col"), 20.0, 25.0, 24, -10.0, -20.0)
    return t.select("name", "row", "col", rnd(cx).alias("cx"))


@check("G5_rotated_grid", with_ctes("points") + """
SELECT name, cast(greatest(least(ceil((24 * 25 - (-x * sin(radians(20)) + y * cos(radians(20)))) / 25) - 1, 23), 0) AS integer) AS row,
 cast(greatest(least(ceil((x * cos(radians(20)) + y * sin(radians(20))) / 20) - 1, 17), 0) AS integer) AS col FROM points""")
def rotated(spark, d):
    row, col = G.cell_of_point(F.col("x"), F.col("y"), 20.0, 25.0, 24, 18, degrees=20.0)
    return points(spark, d).select("name", row.alias("row"), col.alias("col"))


@check("G6_pilot_points", """
WITH g AS (SELECT l_linenumber AS layer, cast(l_suppkey AS integer) AS row, cast(l_partkey % 100 AS integer) AS col, max(cast(l_quantity AS integer) % 4) AS zone FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY row, col) - 1 AS i FROM g WHERE row >= 1 AND col >= 1 AND (row - 1) % 3 = 0 AND (col - 1) % 3 = 0 AND zone > 0)
SELECT 'pp_' || CASE WHEN i < 10000 THEN lpad(cast(i AS varchar), 4, '0') ELSE cast(i AS varchar) END AS name, layer, row, col, zone FROM p""")
def pilot(spark, d):
    g = read(spark, d, "lineitem").groupBy(
        F.col("l_linenumber").alias("layer"), F.col("l_suppkey").cast("int").alias("row"), (F.col("l_partkey") % 100).cast("int").alias("col")).agg(
        F.max(F.col("l_quantity").cast("int") % 4).alias("zone")).withColumn("x", F.col("col") * 1.0).withColumn("y", F.col("row") * 1.0)
    return G.place_pilot_points(g, 3).select("name", "layer", "row", "col", "zone")


def _zone_inputs(spark, d):
    p = points(spark, d)
    pars = p.select("name", (F.col("value") / 1000).alias("mean"), F.when(F.col("zone") == 3, "fixed").otherwise("none").alias("partrans"))
    located = p.where(F.col("x") > 50).select("name", "zone", "x", "y")
    variance = p.select("name", (F.lit(1.0) + F.abs("value") / 10000).alias("var"))
    return pars, located, variance


@check("G7_zone_prior", with_ctes("points") + f"""
SELECT cast(zone AS varchar) AS "group", a AS row, b AS col, {q_rnd('r * sqrt(v1 * v2)')} AS v FROM (SELECT p.zone, p.name AS a, q.name AS b, 1 + abs(p.value) / 10000 AS v1, 1 + abs(q.value) / 10000 AS v2,
  CASE WHEN p.name = q.name THEN 1 ELSE {_BALL.replace('dx', '(p.x - q.x)').replace('dy', '(p.y - q.y)')} / 2.25 END AS r FROM points p JOIN points q ON p.zone = q.zone AND p.name <= q.name WHERE p.x > 50 AND q.x > 50) WHERE abs(r) > 1e-9""")
def prior(spark, d):
    _, located, variance = _zone_inputs(spark, d)
    return G.zone_prior(located, variance, BALL).where(F.abs("v") > 1e-9).withColumn("v", rnd("v"))


@check("G7_zone_draws", with_ctes("points") + "SELECT name, 400 AS n, true AS mean_ok, zone = 3 AS constant FROM points")
def draws(spark, d):
    pars, located, variance = _zone_inputs(spark, d)
    m = G.zone_draws(pars, located, variance, BALL, 400, seed=31).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("a"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return m.join(pars, "name").join(variance, "name").select(
        "name", F.col("n").cast("int").alias("n"), (F.abs(F.col("a") - F.col("mean")) < 6 * F.sqrt(F.col("var") / 400)).alias("mean_ok"),
        (F.col("lo") == F.col("hi")).alias("constant"))


@check("G7_zone_draw_pairs", with_ctes("points") + f"""
SELECT a AS row, b AS col, true AS cov_ok FROM (SELECT p.name AS a, q.name AS b, {_BALL.replace('dx', '(p.x - q.x)').replace('dy', '(p.y - q.y)')} AS v
  FROM points p JOIN points q ON p.zone = q.zone AND p.name < q.name WHERE p.x > 50 AND q.x > 50 AND p.zone <> 3) WHERE v > 1""")
def draw_pairs(spark, d):
    """Pairs with a correlation above 1 / 2.25: the covariance of their draws is the prior's, within 6 standard errors and 0.04 of the factor."""
    n = 200
    pars, located, variance = _zone_inputs(spark, d)
    located = located.where("zone <> 3")
    draws = G.zone_draws(pars, located, variance, BALL, n, seed=37)
    scaled = draws.join(located.select("name"), "name", "left_semi").join(pars.select("name", "mean"), "name").join(variance, "name")
    z = scaled.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct(
        F.col("real").cast("int").alias("i"), ((F.col("value") - F.col("mean")) / F.sqrt("var")).alias("z")))), lambda x: x["z"]).alias("z"))
    pairs = G.point_covariance(located.join(z, "name"), BALL, ["zone"], most=1024, least=1.0, values="z").where((F.col("row") < F.col("col")) & (F.col("v") > 1))
    both = pairs.select("row", "col", (F.col("v") / BALL.sill).alias("r"), "product")
    got = F.col("product") / n
    return both.select("row", "col", (F.abs(got - F.col("r")) < 6 * F.sqrt((1 + F.col("r") * F.col("r")) / n) + 0.04).alias("cov_ok"))


@check("G8_density_curves", with_ctes("ensemble") + f"""
, m AS (SELECT name, avg(value) AS mean, stddev_samp(value) AS std FROM ensemble GROUP BY 1), s AS (SELECT *, unnest(range(0, 50)) AS i FROM m)
SELECT name, 'prior' AS kind, cast(i AS integer) AS i, {q_rnd('mean - 4 * std + i * 8.0::double / 49 * std')} AS x,
 {q_rnd('exp(-0.5 * (-4 + i * 8.0::double / 49) ** 2) / (std * sqrt(2 * pi()))')} AS density FROM s""")
def density(spark, d):
    m = ensemble(spark, d).groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).withColumn("kind", F.lit("prior"))
    return G.density_curves(m).withColumn("x", rnd("x")).withColumn("density", rnd("density"))


@check("N14_autocorrelated_covariance", """
WITH p AS (SELECT l_returnflag || ':' || l_orderkey || ':' || l_linenumber AS obsnme, l_returnflag || l_suppkey AS obgnme, datediff('day', timestamp '1995-01-01', max(l_shipdate)) AS t, 1.0 + max(l_discount) AS std
 FROM lineitem GROUP BY 1, 2)
SELECT a.obgnme AS "group", least(a.obsnme, b.obsnme) AS row, greatest(a.obsnme, b.obsnme) AS col, round(a.std * b.std * 2.0 * exp(-abs(a.t - b.t) / 3.0::double), 6) + 0.0 AS v
FROM p a JOIN p b ON a.obgnme = b.obgnme AND a.obsnme <= b.obsnme AND abs(a.t - b.t) <= 5""")
def noise_cov(spark, d):
    p = read(spark, d, "lineitem").groupBy(
        F.concat_ws(":", "l_returnflag", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("obsnme"),
        F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("obgnme")).agg(
        F.date_diff(F.max("l_shipdate"), F.to_date(F.lit("1995-01-01"))).alias("t"), (F.lit(1.0) + F.max("l_discount")).alias("std"))
    return D.autocorrelated_covariance(p, 2.0, 3.0, 5.0).withColumn("v", rnd("v"))
