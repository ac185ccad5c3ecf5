from __future__ import annotations

from pyspark.sql import functions as F

from brookcal.operators import multipliers as M
from checks.registry import check, q_rnd, q_sig, rnd, sig
from checks.views import _cte, read, residuals, with_ctes


def list_table(spark, d):
    return read(spark, d, "orders").select(
        F.col("o_orderstatus").alias("model_file"), F.col("o_orderkey").alias("key"), F.lit("price").alias("col"),
        F.col("o_totalprice").alias("value"))


def list_steps(spark, d):
    line = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("d"))
    return line.join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderstatus").alias("model_file"), F.col("l_orderkey").alias("key"), F.lit("price").alias("col"),
        F.col("l_linenumber").alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, "add").otherwise("m").alias("op"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("d") * 1000).otherwise(F.lit(1.0) + F.col("d")).alias("m"))


# each step is v -> v * a + b; three of seven steps add, so the fold is written out
_cte("steps", """
SELECT l_orderkey AS key, l_linenumber AS ord, max(l_discount) AS d FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2""")
_FOLD = "value"
for _i in range(1, 8):
    _FOLD = f"({_FOLD} + coalesce(d{_i}, 0) * 1000)" if _i % 2 == 0 else f"({_FOLD} * (1 + coalesce(d{_i}, 0)))"
_cte("folded", "SELECT o_orderkey AS key, o_orderstatus AS model_file, " + _FOLD + """ AS value FROM
 (SELECT o_orderkey, o_orderstatus, max(o_totalprice) AS value, """ + ", ".join(f"max(CASE WHEN ord = {i} THEN d END) AS d{i}" for i in range(1, 8)) + """
  FROM orders LEFT JOIN steps ON key = o_orderkey GROUP BY 1, 2)""", ("steps",))


@check("J9_list_multipliers", with_ctes("folded") + f"""
SELECT key, {q_sig('greatest(least(value, 400000), 50000) / pi()')} AS value FROM folded""")
def lists(spark, d):
    orders = read(spark, d, "orders")
    bounds = orders.select(F.col("o_orderstatus").alias("model_file"), F.lit("price").alias("col"), F.lit(50000.0).alias("lb"),
                           F.lit(400000.0).alias("ub")).distinct()
    t = M.apply_multipliers(list_table(spark, d), list_steps(spark, d), ["model_file", "key", "col"], bounds, ["model_file", "col"])
    return t.select("key", sig(F.col("value") / F.pi()).alias("value"))


@check("J9_matched_key_count", with_ctes("steps") + """
SELECT o_orderstatus AS model_file, ord, 10 AS expected, count(*) AS n_common, count(*) = 10 AS ok FROM steps JOIN orders ON o_orderkey = key GROUP BY 1, 2""")
def matched(spark, d):
    steps = list_steps(spark, d)
    expected = steps.select("model_file", "ord").distinct().withColumn("expected", F.lit(10))
    return M.matched_keys(list_table(spark, d), steps, ["model_file", "key", "col"], expected)


def _cells(spark, d):
    line = read(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").alias("value"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    return line.select(F.concat(F.lit("arr_"), (F.col("l_suppkey") % 5).cast("string")).alias("model_file"),
                       F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c"), "value", "d", "t")


_cte("cells", """
SELECT 'arr_' || l_suppkey % 5 AS model_file, l_suppkey AS r, l_partkey AS c, sum(l_quantity) AS value, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY 2, 3""")


@check("J10_cell_multipliers", with_ctes("cells") + f"""
SELECT model_file, r, c, {q_rnd('greatest(least(value * (1 + d) + t * 10, 60), 5)')} AS value FROM cells""")
def cells(spark, d):
    t = _cells(spark, d)
    steps = t.select("model_file", "r", "c", F.explode(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("*").alias("op"), (F.lit(1.0) + F.col("d")).alias("m")),
        F.struct(F.lit(2).alias("ord"), F.lit("+").alias("op"), (F.col("t") * 10).alias("m")))).alias("s")).select(
        "model_file", "r", "c", "s.*")
    bounds = t.select("model_file", F.lit(5.0).alias("lb"), F.lit(60.0).alias("ub")).distinct()
    out = M.apply_multipliers(t.select("model_file", "r", "c", "value"), steps, ["model_file", "r", "c"], bounds)
    return out.withColumn("value", rnd("value"))


def _flows(spark, d):
    return read(spark, d, "lineitem").groupBy(
        F.year("l_shipdate").alias("kper"), F.col("l_suppkey").alias("segment"), F.col("l_linenumber").alias("reach")).agg(
        F.sum("l_quantity").alias("flaqx"), F.sum("l_tax").alias("flout"))


_cte("flows", """
SELECT cast(year(l_shipdate) AS integer) AS kper, l_suppkey AS segment, l_linenumber AS reach, sum(l_quantity) AS flaqx, sum(l_tax) AS flout FROM lineitem GROUP BY 1, 2, 3""")


@check("J11_segment_group_sums", with_ctes("flows") + f"""
SELECT kper, 'n' || s_nationkey AS obs_base, {q_rnd('sum(flaqx)')} AS flaqx, {q_rnd('sum(flout)')} AS flout FROM flows JOIN supplier ON s_suppkey = segment GROUP BY 1, 2""")
def segment_sums(spark, d):
    seg = read(spark, d, "supplier").select(F.col("s_suppkey").alias("segment"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("obs_base"))
    return M.segment_group_sums(_flows(spark, d), seg).select("kper", "obs_base", rnd("flaqx").alias("flaqx"), rnd("flout").alias("flout"))


@check("J12_near_time_match", """
SELECT event_id, value FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT p_retailprice / 50 AS t FROM part) p WHERE abs(e.value - t) <= 1e-8 + 1e-5 * abs(t))""")
def near(spark, d):
    times = read(spark, d, "part").select((F.col("p_retailprice") / 50).alias("value"))
    return M.near_times(read(spark, d, "events").select("event_id", "value"), times, "value")


@check("J13_period_multipliers", with_ctes("flows") + f"""
SELECT kper, segment, reach, {q_rnd('flaqx * (CASE WHEN kper % 2 = 0 THEN kper / 1000.0 ELSE 1 END)')} AS flaqx, {q_rnd('flout')} AS flout FROM flows""")
def periods(spark, d):
    f = _flows(spark, d)
    m = f.where("kper % 2 = 0").select("kper", (F.col("kper") / 1000.0).alias("flaqx")).distinct()
    return M.period_multipliers(f, m, ["flaqx"]).select("kper", "segment", "reach", rnd("flaqx").alias("flaqx"), rnd("flout").alias("flout"))


def _grid(spark, d):
    return read(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("k"), (F.col("l_suppkey") + 1).alias("i"), (F.col("l_partkey") % 10 + 1).alias("j")).agg(
        F.sum("l_quantity").alias("flux"), F.max("l_tax").alias("cond"))


_cte("grid", """
SELECT l_returnflag AS file, l_linenumber AS k, l_suppkey + 1 AS i, l_partkey % 10 + 1 AS j, sum(l_quantity) AS flux, max(l_tax) AS cond FROM lineitem GROUP BY 1, 2, 3, 4""")


@check("J16_reindexed_multipliers", with_ctes("grid") + f"""
SELECT file, k, i, j, {q_rnd('CASE WHEN k <= 4 THEN flux * (1 + j / 10.0) * (CASE file WHEN \'A\' THEN 2 ELSE 1 END) END')} AS flux,
 {q_rnd('CASE WHEN k <= 4 THEN cond * 0.5 * (CASE file WHEN \'R\' THEN 3 ELSE 1 END) END')} AS cond FROM grid""")
def reindexed(spark, d):
    g = _grid(spark, d)
    m = g.where("k <= 4").select((F.col("k") - 1).alias("k"), (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"),
                                 (F.lit(1.0) + F.col("j") / 10.0).alias("flux"), F.lit(0.5).alias("cond")).distinct()
    const = spark.createDataFrame([("A", "flux", 2.0), ("R", "cond", 3.0)], "file string, col string, val double")
    t = M.reindexed_multipliers(g, m, ["flux", "cond"], const)
    return t.select("file", "k", "i", "j", rnd("flux").alias("flux"), rnd("cond").alias("cond"))


@check("J17_barrier_multipliers", with_ctes("grid") + f"""
, m AS (SELECT DISTINCT k, i, j, k * 0.1 AS mult FROM grid WHERE flux > 20)
SELECT file, k AS lay, i AS irow1, j AS icol1, i + 1 AS irow2, j AS icol2, {q_rnd('flux * coalesce(mult, 1)')} AS hydchr
FROM grid LEFT JOIN m USING (k, i, j)""")
def barriers(spark, d):
    g = _grid(spark, d).select("file", F.col("k").alias("lay"), F.col("i").alias("irow1"), F.col("j").alias("icol1"),
                                                   (F.col("i") + 1).alias("irow2"), F.col("j").alias("icol2"), F.col("flux").alias("hydchr"))
    m = g.where("hydchr > 20").drop("file", "hydchr").distinct().withColumn("hydchr", F.col("lay") * 0.1)
    return M.barrier_multipliers(g, m).select("file", "lay", "irow1", "icol1", "irow2", "icol2", rnd("hydchr").alias("hydchr"))


@check("J18_listed_reaches", with_ctes("flows") + f"""
SELECT kper, s_name || '_' || reach AS obs_base, {q_rnd('flaqx')} AS flaqx, {q_rnd('flout')} AS flout FROM flows JOIN supplier ON s_suppkey = segment WHERE reach = s_nationkey % 7 + 1""")
def reaches(spark, d):
    keys = read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("segment"), (F.col("s_nationkey") % 7 + 1).alias("reach"),
        F.concat_ws("_", "s_name", (F.col("s_nationkey") % 7 + 1).cast("string")).alias("obs_base"))
    return M.listed_reaches(_flows(spark, d), keys).select("kper", "obs_base", rnd("flaqx").alias("flaqx"), rnd("flout").alias("flout"))


@check("J19_site_series", with_ctes("flows") + f"""
, c AS (SELECT reach AS k, segment AS i, kper AS t, CASE WHEN flaqx < 300 THEN 1e30 ELSE flaqx END AS v FROM flows),
s AS (SELECT s_name AS site, s_suppkey AS i, s_nationkey % 6 + 1 AS k FROM supplier)
SELECT site, c.t AS time, {q_rnd('coalesce(CASE WHEN c.v >= 1e29 THEN l.v ELSE c.v END, -1)')} AS value
FROM s JOIN c ON c.i = s.i AND c.k = s.k LEFT JOIN c l ON l.i = s.i AND l.k = s.k + 1 AND l.t = c.t""")
def sites(spark, d):
    cells_ = _flows(spark, d).select(F.col("reach").alias("k"), F.col("segment").alias("i"), F.lit(1).alias("j"), F.col("kper").alias("time"),
                                     F.when(F.col("flaqx") < 300, 1e30).otherwise(F.col("flaqx")).alias("value"))
    s = read(spark, d, "supplier").select(F.col("s_name").alias("site"), (F.col("s_nationkey") % 6 + 1).alias("k"),
                                          F.col("s_suppkey").alias("i"), F.lit(1).alias("j"))
    return M.site_series(cells_, s, 1e30, fill=-1.0).withColumn("value", rnd("value"))


@check("P36_mixed_column_cleaning", f"""
SELECT event_id, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 0 WHEN event_type = 'error' THEN 1e30::double ELSE value END AS conc
FROM events WHERE hour(ts) IN (SELECT s_nationkey FROM supplier)""")
def mixed(spark, d):
    kind = F.col("event_type")
    raw = read(spark, d, "events").select(
        "event_id", F.hour("ts").alias("time"),
        F.when(kind == "click", F.lit("1.5-301")).when(kind == "view", F.concat(F.lit("-"), F.col("value").cast("string")))
        .when(kind == "error", F.lit("9.9e35")).otherwise(F.col("value").cast("string")).alias("conc"))
    times = read(spark, d, "supplier").select(F.col("s_nationkey").alias("time"))
    return M.clean_mixed(raw, ["conc"], times).select("event_id", "conc")


@check("P37_magnitude_clip", """
SELECT c_custkey, greatest(least(CASE WHEN c_nationkey = 3 THEN 0 ELSE c_acctbal END, 5000.0), -5000.0) AS value FROM customer""")
def clipped(spark, d):
    v = F.when(F.col("c_nationkey") == 3, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return read(spark, d, "customer").select("c_custkey", M.clip_magnitude(v, -5000.0).alias("value"))


_STAT = {"mean": "avg({c})", "stdev": "stddev_pop({c})", "min": "min({c})", "max": "max({c})", "upper_bound": "count(CASE WHEN {c} = 90 THEN 1 END)",
         "lower_bound": "count(CASE WHEN {c} = 3 THEN 1 END)", "quantile_05": "quantile_cont({c}, 0.05)", "quantile_25": "quantile_cont({c}, 0.25)",
         "median": "quantile_cont({c}, 0.5)", "quantile_75": "quantile_cont({c}, 0.75)", "quantile_95": "quantile_cont({c}, 0.95)"}


@check("A20_array_summary", with_ctes("cells") + ", z AS (SELECT model_file, value AS org, greatest(least(value * (1 + d), 90), 3) AS new FROM cells WHERE r % 3 <> 0) SELECT model_file, " + ", ".join(
    f"{q_rnd(f.format(c='new'))} AS {s}, {q_rnd(f.format(c='org'))} AS {s}_org, {q_rnd('(' + f.format(c='org') + ') - (' + f.format(c='new') + ')')} AS {s}_dif" for s, f in _STAT.items()) + " FROM z GROUP BY 1")
def array_stats(spark, d):
    t = _cells(spark, d).select("model_file", F.col("value").alias("org"), F.greatest(F.least(F.col("value") * (1 + F.col("d")), F.lit(90.0)), F.lit(3.0)).alias("new"),
                                (F.col("r") % 3).alias("zone"))
    b = t.select("model_file", F.lit(3.0).alias("lb"), F.lit(90.0).alias("ub")).distinct()
    out = M.array_summary(t, b, "zone")
    return out.select("model_file", *[rnd(c).alias(c) for s in _STAT for c in (s, f"{s}_org", f"{s}_dif")])


@check("W8_time_differences", with_ctes("residuals") + f"""
, p AS (SELECT *, lead(name) OVER w AS n2, lead(measured) OVER w AS m2, lead(weight) OVER w AS w2 FROM residuals WHERE weight > 0 WINDOW w AS (PARTITION BY "group" ORDER BY name))
SELECT 'dif_' || name || '__' || n2 AS obsnme, 'dif_' || "group" AS obgnme, {q_rnd('measured - m2')} AS diff_obsval, {q_rnd('1 / sqrt((1 / weight) ** 2 + (1 / w2) ** 2)')} AS weight FROM p WHERE n2 IS NOT NULL""")
def differences(spark, d):
    obs = residuals(spark, d).select(F.col("name").alias("obsnme"), F.col("group").alias("obgnme"), F.col("measured").alias("obsval"), "weight")
    t = M.time_differences(obs)
    return t.select("obsnme", "obgnme", rnd("diff_obsval").alias("diff_obsval"), rnd("weight").alias("weight"))


@check("W8_time_differences_with_zeros", with_ctes("residuals") + f"""
, p AS (SELECT *, lead(name) OVER w AS n2, lead(measured) OVER w AS m2, lead(weight) OVER w AS w2 FROM residuals WINDOW w AS (PARTITION BY "group" ORDER BY name))
SELECT 'dif_' || name || '__' || n2 AS obsnme, {q_rnd('measured - m2')} AS diff_obsval,
 {q_rnd('CASE WHEN weight > 0 AND w2 > 0 THEN 1 / sqrt((1 / weight) ** 2 + (1 / w2) ** 2) ELSE 0 END')} AS weight FROM p WHERE n2 IS NOT NULL""")
def differences_with_zeros(spark, d):
    obs = residuals(spark, d).select(F.col("name").alias("obsnme"), F.col("group").alias("obgnme"), F.col("measured").alias("obsval"), "weight")
    t = M.time_differences(obs, include_zero_weight=True)
    return t.select("obsnme", rnd("diff_obsval").alias("diff_obsval"), rnd("weight").alias("weight"))


@check("W8_apply_time_differences", with_ctes("residuals") + f"""
, p AS (SELECT *, lead(name) OVER w AS n2, lead(modelled) OVER w AS m2 FROM residuals WHERE weight > 0 WINDOW w AS (PARTITION BY "group" ORDER BY name))
SELECT 'dif_' || name || '__' || n2 AS obsnme, {q_rnd('modelled')} AS diff1_obsval, {q_rnd('m2')} AS diff2_obsval, {q_rnd('modelled - m2')} AS diff_obsval FROM p WHERE n2 IS NOT NULL""")
def apply_differences(spark, d):
    res = residuals(spark, d)
    obs = res.select(F.col("name").alias("obsnme"), F.col("group").alias("obgnme"), F.col("measured").alias("obsval"), "weight")
    t = M.apply_time_differences(M.time_differences(obs), res.select("name", F.col("modelled").alias("value")))
    return t.select("obsnme", *[rnd(c).alias(c) for c in ("diff1_obsval", "diff2_obsval", "diff_obsval")])


@check("F3_statistic_registry", with_ctes("cells") + f"SELECT model_file, count(*) AS n, {q_rnd('avg(value)')} AS mean, {q_rnd('quantile_cont(value, 0.5)')} AS median FROM cells GROUP BY 1")
def statistic_registry(spark, d):
    t = _cells(spark, d).select("model_file", F.col("value").alias("new"), F.col("value").alias("org"))
    return M.array_summary(t, statistics=["mean", "median"]).select("model_file", "n", rnd("mean").alias("mean"), rnd("median").alias("median"))
