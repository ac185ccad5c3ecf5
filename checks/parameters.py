from __future__ import annotations

from pyspark.sql import functions as F

from brookcal.operators import parameters as P
from checks.registry import check, q_rnd, rnd
from checks.views import _cte, par_ensemble, parameters, read, with_ctes


def nested_par(spark, d):
    """Each part as a nested parameter: one id per supplier slot, twelve months."""
    size = F.col("p_size")
    ids = F.sequence(F.lit(1), size % 4 + 1)
    values = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.transform(ids, lambda i: F.col("p_retailprice") + m * 10 + i))
    return read(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("par"), ids.alias("ids"), values.alias("values"))


@check("P17_parameter_expansion", f"""
SELECT 'p' || p_partkey || ':hru_' || i || ':mon_' || m AS parnme, {q_rnd('p_retailprice + m * 10 + i')} AS parval1
FROM (SELECT p_partkey, p_retailprice, m, unnest(range(1, p_size % 4 + 2)) AS i FROM
  (SELECT *, unnest(range(1, 13)) AS m FROM part))""")
def expansion(spark, d):
    return P.expand(nested_par(spark, d), "hru", monthly=True).withColumn("parval1", rnd("parval1"))


_cte("bounds_table", """
SELECT p_brand AS parameter_name, CASE WHEN max(p_partkey) % 2 = 0 THEN 'Percent' ELSE 'Range' END AS method,
 min(p_retailprice) AS par_lower_bound, max(p_retailprice) AS par_upper_bound FROM part GROUP BY 1""")


def bounds_table(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("parameter_name")).agg(
        F.when(F.max("p_partkey") % 2 == 0, "Percent").otherwise("Range").alias("method"),
        F.min("p_retailprice").alias("par_lower_bound"), F.max("p_retailprice").alias("par_upper_bound"))


@check("P18_bounds_by_method", with_ctes("parameters", "bounds_table") + f"""
SELECT parnme, {q_rnd("CASE WHEN method = 'Percent' THEN v - v * 0.2 ELSE par_lower_bound END")} AS parlbnd,
 {q_rnd("CASE WHEN method = 'Percent' THEN v + v * 0.2 ELSE par_upper_bound END")} AS parubnd,
 CASE WHEN method = 'Percent' THEN v < 0 ELSE false END AS inverted
FROM (SELECT *, parval1 - 910 AS v FROM parameters) JOIN bounds_table ON parameter_name = pargp""")
def bounds(spark, d):
    pars = parameters(spark, d).withColumn("parval1", F.col("parval1") - 910)
    t = P.bounds_by_method(pars, bounds_table(spark, d))
    bad = P.inverted_bounds(t).select("parnme", F.lit(True).alias("inverted"))
    return t.join(bad, "parnme", "left").select(
        "parnme", rnd("parlbnd").alias("parlbnd"), rnd("parubnd").alias("parubnd"),
        F.coalesce("inverted", F.lit(False)).alias("inverted"))


@check("P19_transform_flag", with_ctes("parameters") + """
SELECT parnme, CASE WHEN parlbnd - 400 <= 0 THEN 'none' ELSE partrans END AS partrans FROM parameters""")
def flag(spark, d):
    return P.transform_flag(parameters(spark, d).withColumn("parlbnd", F.col("parlbnd") - 400)).select("parnme", "partrans")


@check("P20_bound_override", with_ctes("parameters") + f"""
SELECT parnme, {q_rnd('CASE WHEN parubnd < parval1 THEN 0 ELSE parlbnd END')} AS parlbnd,
 {q_rnd('CASE WHEN parubnd < parval1 THEN parval1 * 2 ELSE parubnd END')} AS parubnd FROM parameters""")
def overrides(spark, d):
    p = parameters(spark, d)
    fix = p.where("parubnd < parval1").select("parnme", F.lit(0.0).alias("parlbnd"), (F.col("parval1") * 2).alias("parubnd"))
    return P.override(p, fix).select("parnme", rnd("parlbnd").alias("parlbnd"), rnd("parubnd").alias("parubnd"))


@check("P21_bound_clipping", with_ctes("parameters") + f"""
SELECT parnme, {q_rnd('greatest(least(parval1 - 200 + partkey % 900, parubnd), parlbnd)')} AS parval1
FROM (SELECT *, cast(split_part(parnme, '_', 2) AS integer) AS partkey FROM parameters)""")
def clipping(spark, d):
    key = F.element_at(F.split("parnme", "_"), 2).cast("int")
    p = parameters(spark, d).withColumn("parval1", F.col("parval1") - 200 + key % 900)
    return P.enforce_bounds(p).select("parnme", rnd("parval1").alias("parval1"))


def _trans(c: str) -> str:
    return f"CASE WHEN partrans = 'log' THEN log10({c} * scale + \"offset\") ELSE {c} * scale + \"offset\" END"


@check("P22_transformed_columns", with_ctes("parameters") + f"""
SELECT parnme, {q_rnd(_trans('parval1'))} AS parval1_trans, {q_rnd(_trans('parlbnd'))} AS parlbnd_trans, {q_rnd(_trans('parubnd'))} AS parubnd_trans FROM parameters""")
def transformed(spark, d):
    t = P.transformed_columns(parameters(spark, d))
    return t.select("parnme", *[rnd(f"{c}_trans").alias(f"{c}_trans") for c in ("parval1", "parlbnd", "parubnd")])


_cte("par_groups", """
SELECT pargp, CASE n % 3 WHEN 0 THEN 'absolute' WHEN 1 THEN 'relative' ELSE 'rel_to_max' END AS inctyp,
 CASE n % 3 WHEN 0 THEN 25.0::double ELSE 0.05::double END AS derinc
FROM (SELECT DISTINCT pargp, cast(split_part(pargp, '#', 2) AS integer) AS n FROM parameters)""", ("parameters",))


def par_groups(spark, d):
    n = F.element_at(F.split("pargp", "#"), 2).cast("int") % 3
    return parameters(spark, d).select("pargp").distinct().select(
        "pargp", F.when(n == 0, "absolute").when(n == 1, "relative").otherwise("rel_to_max").alias("inctyp"),
        F.when(n == 0, 25.0).otherwise(0.05).alias("derinc"))


@check("P23_perturbations", with_ctes("par_groups") + f"""
, e AS (SELECT * EXCLUDE (parval1), greatest(least(parval1, parubnd), parlbnd) AS v FROM parameters),
i AS (SELECT *, CASE WHEN partrans = 'fixed' THEN v WHEN inctyp = 'absolute' THEN derinc WHEN inctyp = 'relative' THEN derinc * v
  ELSE derinc * max(v) OVER (PARTITION BY inctyp) END AS inc FROM e JOIN par_groups g ON g.pargp = e.pargp)
SELECT parnme, {q_rnd('inc')} AS increment, {q_rnd('CASE WHEN v + inc > parubnd THEN v - inc ELSE v + inc END')} AS perturbation,
 v + inc > parubnd AND v - inc < parlbnd AS out_of_bounds FROM i""")
def perturb(spark, d):
    t = P.perturbations(parameters(spark, d), par_groups(spark, d))
    return t.select("parnme", rnd("increment").alias("increment"), rnd("perturbation").alias("perturbation"), "out_of_bounds")


@check("P24_change_limits", with_ctes("parameters") + f"""
, b AS (SELECT *, CASE WHEN v = 0 THEN parubnd / 4 ELSE v END AS b FROM (SELECT *, parval1 - 905 AS v FROM parameters)),
l AS (SELECT *, CASE WHEN parchglim = 'factor' THEN CASE WHEN b < 0 THEN b / 5 WHEN b > 0 THEN b * 5 END ELSE b + abs(b) * 0.3 END AS up,
 CASE WHEN parchglim = 'factor' THEN CASE WHEN b < 0 THEN b * 5 WHEN b > 0 THEN b / 5 END ELSE b - abs(b) * 0.3 END AS lo FROM b)
SELECT parnme, {q_rnd('up')} AS chg_upper, {q_rnd('lo')} AS chg_lower, {q_rnd('least(parubnd, up)')} AS eff_upper, {q_rnd('greatest(parlbnd, lo)')} AS eff_lower FROM l""")
def limits(spark, d):
    p = parameters(spark, d).withColumn("parval1", F.col("parval1") - 905)
    t = P.change_limits(p, factor_max=5.0, relative_max=0.3)
    return t.select("parnme", *[rnd(c).alias(c) for c in ("chg_upper", "chg_lower", "eff_upper", "eff_lower")])


@check("P25_at_bounds", with_ctes("parameters") + """
, a AS (SELECT * FROM parameters WHERE partrans NOT IN ('tied', 'fixed'))
SELECT parnme, 'upper' AS side FROM a WHERE parval1 >= 0.95 * parubnd UNION ALL SELECT parnme, 'lower' FROM a WHERE parval1 <= 1.05 * parlbnd""")
def near(spark, d):
    return P.at_bounds(parameters(spark, d), 0.05)


@check("P33_replace_from_realization", with_ctes("parameters", "par_ensemble") + f"""
SELECT parnme, {q_rnd('greatest(least(coalesce(e.value, parval1), parubnd), parlbnd)')} AS parval1
FROM parameters LEFT JOIN par_ensemble e ON e.name = parnme AND e.real = 'base'""")
def replace(spark, d):
    t = P.replace_from_realization(parameters(spark, d), par_ensemble(spark, d), clip_to_bounds=True)
    return t.select("parnme", rnd("parval1").alias("parval1"))


@check("P33_replace_without_base", with_ctes("parameters", "par_ensemble") + f"""
SELECT parnme, {q_rnd('coalesce(e.value, parval1)')} AS parval1
FROM parameters LEFT JOIN par_ensemble e ON e.name = parnme AND e.real = '1'""")
def replace_lost(spark, d):
    t = P.replace_from_realization(parameters(spark, d), par_ensemble(spark, d).where("real <> 'base'"))
    return t.select("parnme", rnd("parval1").alias("parval1"))


_SPAN = "CASE WHEN partrans = 'log' THEN log10(parubnd) - log10(parlbnd) ELSE parubnd - parlbnd END"


@check("P34_prior_equations", with_ctes("parameters") + f"""
SELECT parnme AS pilbl, (CASE WHEN partrans = 'log' THEN '1.0 * log(' || parnme || ')' ELSE '1.0 * ' || parnme END) || ' = '
  || printf('%15.6E', CASE WHEN partrans = 'log' THEN log10(parval1) ELSE parval1 END) AS equation,
 {q_rnd(f'1 / ({_SPAN})')} AS weight, 'regul_' || pargp AS obgnme
FROM parameters WHERE partrans NOT IN ('tied', 'fixed')""")
def prior(spark, d):
    return P.prior_equations(parameters(spark, d)).withColumn("weight", rnd("weight"))


def _terms(spark, d):
    line = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return (
        line.join(part, "l_partkey")
        .groupBy(F.concat(F.lit("eq_"), F.col("l_orderkey").cast("string")).alias("pilbl"), F.col("l_partkey").alias("ord"),
                 F.concat(F.col("p_brand"), F.lit(":hru_"), F.col("l_partkey").cast("string")).alias("parnme"),
                 (F.col("p_size") % 2 == 0).alias("islog"))
        .agg(F.sum("l_quantity").alias("coef"))
        .withColumn("rhs", F.lit(1.5)).withColumn("weight", F.lit(1.0)).withColumn("obgnme", F.lit("regul")))


_cte("terms", """
SELECT 'eq_' || l_orderkey AS pilbl, l_partkey AS ord, p_brand || ':hru_' || l_partkey AS parnme, p_size % 2 = 0 AS islog,
 p_size % 5 IN (0, 2) AS broken, sum(l_quantity) AS coef FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5""")


@check("P35_equation_builder", with_ctes("terms") + """
SELECT pilbl, string_agg(printf('%.6f', coef) || ' * ' || CASE WHEN islog THEN 'log(' || parnme || ')' ELSE parnme END, ' + ' ORDER BY ord)
 || ' = 1.500000' AS equation FROM terms GROUP BY 1""")
def equations(spark, d):
    return P.build_equations(_terms(spark, d)).select("pilbl", "equation")


@check("P35_equation_parser", with_ctes("terms") + "SELECT DISTINCT pilbl, parnme FROM terms")
def equation_names(spark, d):
    return P.equation_parameters(P.build_equations(_terms(spark, d)))


@check("P35_drop_broken_equations", with_ctes("terms") + "SELECT pilbl FROM terms GROUP BY 1 HAVING NOT bool_or(broken)")
def rectify(spark, d):
    return P.drop_broken_equations(P.build_equations(_terms(spark, d)), parameters(spark, d)).select("pilbl")


def _par_values(spark, d):
    return par_ensemble(spark, d).select(
        F.col("real").alias("iteration"), F.col("name").alias("parnme"), "value")


@check("A17_bounds_report", with_ctes("parameters", "par_ensemble") + """
SELECT e.real AS iteration, coalesce(pargp, 'total') AS pargp, count(*) AS n, count(CASE WHEN value <= parlbnd THEN 1 END) AS at_lower,
 count(CASE WHEN value >= parubnd THEN 1 END) AS at_upper, count(CASE WHEN value <= parlbnd OR value >= parubnd THEN 1 END) AS at_either
FROM par_ensemble e JOIN parameters ON parnme = e.name WHERE partrans NOT IN ('tied', 'fixed') GROUP BY GROUPING SETS ((e.real, pargp), (e.real))""")
def report(spark, d):
    return P.bounds_report(_par_values(spark, d), parameters(spark, d))


def _lg(c: str) -> str:
    return f"CASE WHEN partrans = 'log' THEN log10({c}) ELSE {c} END"


@check("A18_parameter_summary", with_ctes("parameters") + f"""
SELECT pargp, count(*) AS count, CASE WHEN min(partrans) = max(partrans) THEN min(partrans) ELSE 'mixed' END AS transform,
 {q_rnd(f"min({_lg('parval1')})")} AS parval1_min, {q_rnd(f"max({_lg('parval1')})")} AS parval1_max,
 {q_rnd(f"min({_lg('parlbnd')})")} AS parlbnd_min, {q_rnd(f"max({_lg('parubnd')})")} AS parubnd_max,
 {q_rnd(f"min(({_SPAN}) / 4)")} AS stdev_min, {q_rnd(f"max(({_SPAN}) / 4)")} AS stdev_max FROM parameters GROUP BY 1""")
def summary(spark, d):
    t = P.summary_table(parameters(spark, d))
    return t.select("pargp", "count", "transform",
                    *[rnd(c).alias(c) for c in ("parval1_min", "parval1_max", "parlbnd_min", "parubnd_max", "stdev_min", "stdev_max")])


@check("U5_keep_first", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def first(spark, d):
    return P.keep_first(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@check("U6_group_sync", with_ctes("par_groups") + """
SELECT u.pargp AS pargpnme, coalesce(inctyp, 'relative') AS inctyp, coalesce(derinc, 0.01) AS derinc
FROM (SELECT DISTINCT pargp FROM parameters) u LEFT JOIN (SELECT * FROM par_groups WHERE inctyp <> 'absolute') g ON g.pargp = u.pargp""")
def sync(spark, d):
    known = par_groups(spark, d).where("inctyp <> 'absolute'").withColumnRenamed("pargp", "pargpnme")
    return P.sync_groups(parameters(spark, d), known, {"inctyp": "relative", "derinc": 0.01})


def incidence(spark, d):
    return read(spark, d, "lineitem").join(
        read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").select(
        F.col("p_type").alias("obgnme"), F.col("l_suppkey").cast("string").alias("par"),
        F.when(F.col("l_quantity") > 49, 1).otherwise(0).alias("v"))


_cte("sets", """
SELECT par, string_agg(p_type, '|' ORDER BY p_type) AS types FROM (SELECT DISTINCT cast(l_suppkey AS varchar) AS par, p_type
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49) GROUP BY 1""")
_cte("combos", """
SELECT par, types, 'obs_combo_' || dense_rank() OVER (ORDER BY list_sort(string_split(types, '|'))) AS pargp FROM sets""", ("sets",))


@check("A21_combination_groups", with_ctes("combos") + "SELECT par, pargp FROM combos")
def combos(spark, d):
    return P.combination_groups(incidence(spark, d)).select("par", "pargp")


@check("A21_group_incidence", with_ctes("combos") + """
SELECT DISTINCT unnest(string_split(types, '|')) AS obgnme, pargp, 1 AS v FROM combos""")
def group_incidence(spark, d):
    return P.group_incidence(P.combination_groups(incidence(spark, d)))


@check("J5_drop_zero_groups", with_ctes("observations") + """
SELECT o.obgnme, s.obsnme FROM (SELECT DISTINCT obgnme FROM observations) o JOIN observations s ON s.obgnme = o.obgnme
WHERE o.obgnme IN (SELECT obgnme FROM observations WHERE weight > 0)""")
def localisation(spark, d):
    from brookcal.operators import observations as O
    from checks.views import observations

    obs = observations(spark, d)
    return obs.select("obgnme", "obsnme").join(O.zero_weight_groups(obs), "obgnme", "left_anti")


@check("J6_listed_realizations", with_ctes("par_ensemble") + f"""
SELECT real, name, {q_rnd('value')} AS value FROM par_ensemble WHERE real IN (SELECT cast(s_suppkey AS varchar) FROM supplier WHERE s_acctbal > 4000)""")
def listed(spark, d):
    keep = read(spark, d, "supplier").where("s_acctbal > 4000").select(F.col("s_suppkey").cast("string").alias("real"))
    return par_ensemble(spark, d).join(keep, "real", "left_semi").select("real", "name", rnd("value").alias("value"))


@check("J7_prefix_join", with_ctes("parameters", "bounds_table") + """
SELECT parnme, method FROM parameters JOIN bounds_table ON starts_with(parnme, parameter_name || ':')""")
def prefix(spark, d):
    table = bounds_table(spark, d).select(F.col("parameter_name").alias("prefix"), "method")
    return P.localized_pairs(parameters(spark, d).select("parnme"), table).select("parnme", "method")


@check("N24_perturbation_table", with_ctes("parameters") + f"""
, a AS (SELECT * FROM parameters WHERE partrans NOT IN ('tied', 'fixed')),
s AS (SELECT *, unnest(range(1, 4)) AS k FROM a)
SELECT 'base' AS run, parnme, {q_rnd('parval1')} AS value FROM a
UNION ALL SELECT parnme || '_' || k, parnme, {q_rnd('CASE WHEN parval1 + 40.0 * k > parubnd OR parval1 + 40.0 * k < parlbnd THEN parval1 - 40.0 * k ELSE parval1 + 40.0 * k END')} FROM s""")
def steps(spark, d):
    p = parameters(spark, d)
    return P.perturbation_table(p, 3, p.select("parnme", F.lit(40.0).alias("increment"))).withColumn("value", rnd("value"))
