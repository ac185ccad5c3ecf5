from __future__ import annotations

from pyspark.sql import functions as F

from brookcal.functions import names
from brookcal.operators import series
from brookcal.session import ROWS_PER_TASK, spread_rows
from checks.registry import check, q_rnd, rnd
from checks.views import daily, daily_by_var, gauge_flow, read, with_ctes

PERIOD = ("1996-01-01", "2000-12-31")
WINDOWS = {"A": ("1996-01-01", "1999-12-31"), "N": ("1997-03-01", "2000-06-30"), "R": ("1995-01-01", "1998-12-31")}


@check("P1_calibration_period", with_ctes("daily_by_var") + f"""
SELECT var, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day, {q_rnd('sum(value)')} AS total
FROM daily_by_var WHERE (var = 'A' AND day BETWEEN date '1996-01-01' AND date '1999-12-31')
 OR (var = 'N' AND day BETWEEN date '1997-03-01' AND date '2000-06-30')
 OR (var = 'R' AND day BETWEEN date '1995-01-01' AND date '1998-12-31') GROUP BY var""")
def period(spark, d):
    kept = series.period_slice_by_variable(daily_by_var(spark, d), WINDOWS)
    return kept.groupBy("var").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        rnd(F.sum("value")).alias("total"))


@check("P2_location_subset", with_ctes("daily") + """
SELECT loc, day, value FROM daily WHERE loc IN
 (SELECT lpad(cast(s_suppkey AS varchar), 8, '0') FROM supplier WHERE s_acctbal > 3000)""")
def locations(spark, d):
    keep = read(spark, d, "supplier").where(F.col("s_acctbal") > 3000).select(
        F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("loc"))
    return series.keep_locations(daily(spark, d), keep)


@check("P3_segment_relabel", """
SELECT s.s_name AS loc, cast(l_shipdate AS date) AS day, sum(l_quantity) AS value
FROM lineitem JOIN supplier s ON l_suppkey = s.s_suppkey GROUP BY 1, 2""")
def segments(spark, d):
    seg = read(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("segment"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("value"))
    gauges = read(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("segment_index"),
                                               F.col("s_name").alias("gauge_id"))
    return series.relabel_segments(seg, gauges).select("loc", "day", "value")


@check("P4_month_exclusion", with_ctes("daily") + """
SELECT loc, cast(month(day) AS integer) AS month, count(*) AS n FROM daily WHERE month(day) NOT IN (7, 8) GROUP BY 1, 2""")
def months(spark, d):
    return series.exclude_months(daily(spark, d)).groupBy("loc", F.month("day").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


@check("P5_derived_flow", with_ctes("daily_by_var") + """
SELECT loc, day, max(CASE WHEN var = 'A' THEN value END) + max(CASE WHEN var = 'N' THEN value END)
  + max(CASE WHEN var = 'R' THEN value END) AS value, 'total_flow' AS var
FROM daily_by_var GROUP BY loc, day""")
def derived(spark, d):
    return series.derived_sum(daily_by_var(spark, d), ["A", "N", "R"], "total_flow")


@check("P6_unit_conversion", with_ctes("daily") + f"""
SELECT loc, day, {q_rnd('value / 86400', 9)} AS value FROM daily""")
def units(spark, d):
    return series.per_second(daily(spark, d)).withColumn("value", rnd("value", 9))


@check("P7_fill_missing", with_ctes("daily") + """
SELECT loc, day, coalesce(CASE WHEN value < 5 THEN NULL ELSE value END, -9999.0) AS value FROM daily""")
def fill(spark, d):
    v = F.when(F.col("value") >= 5, F.col("value")).otherwise(F.lit(float("nan")))
    return daily(spark, d).withColumn("value", series.fill_missing(v))


@check("P8_sentinel_to_missing", with_ctes("daily") + """
SELECT loc, count(CASE WHEN value >= 5 THEN 1 END) AS kept, count(CASE WHEN value < 5 THEN 1 END) AS missing
FROM daily GROUP BY loc""")
def sentinel(spark, d):
    coded = F.when(F.col("value") < 5, F.lit(-9999.0)).otherwise(F.col("value"))
    clean = daily(spark, d).withColumn("value", series.drop_sentinel(coded))
    return clean.groupBy("loc").agg(F.count("value").alias("kept"),
                                    F.count_if(F.col("value").isNull()).alias("missing"))


@check("P9_negative_flow", with_ctes("gauge_flow") + "SELECT loc, day, discharge FROM gauge_flow WHERE discharge < 0")
def negatives(spark, d):
    return series.negative_rows(gauge_flow(spark, d), "discharge")


@check("P10_composite_names", with_ctes("daily") + """
SELECT loc, day, 'flow_mon:' || year(day) || '_' || month(day) || ':' || loc AS monthly,
 'flow_ann:' || year(day) || ':' || loc AS annual, 'flow_mean_mon:' || month(day) || ':' || loc AS climatology,
 'flow_daily:' || year(day) || '_' || month(day) || '_' || day(day) || ':' || loc AS daily,
 'streamflow_daily_' || (CASE WHEN value > 60 THEN '1_2' ELSE '-9999_-9999' END) || ':' || year(day) || '_' || month(day)
   || '_' || day(day) || ':' || loc AS flow_name FROM daily""")
def build(spark, d):
    day, loc = F.col("day"), F.col("loc")
    high = F.col("value") > 60
    return daily(spark, d).select(
        "loc", "day",
        names.build_name("flow_mon", names.month_period(day), loc).alias("monthly"),
        names.build_name("flow_ann", F.year(day), loc).alias("annual"),
        names.build_name("flow_mean_mon", F.month(day), loc).alias("climatology"),
        names.build_name("flow_daily", names.day_period(day), loc).alias("daily"),
        names.daily_flow_name(F.when(high, 1), F.when(high, 2), day, loc).alias("flow_name"))


_KINDS = ["flow_mon", "flow_ann", "flow_mean_mon", "flow_daily"]


@check("P11_name_parser", with_ctes("daily") + """
SELECT 'flow_mon:' || year(day) || '_' || month(day) || ':' || loc AS name, 'flow_mon' AS grp, loc,
  cast(year(day) AS integer) AS year, cast(month(day) AS integer) AS month, cast(NULL AS date) AS date FROM daily
UNION SELECT 'flow_ann:' || year(day) || ':' || loc, 'flow_ann', loc, cast(year(day) AS integer), NULL, NULL FROM daily
UNION SELECT 'flow_mean_mon:' || month(day) || ':' || loc, 'flow_mean_mon', loc, NULL, cast(month(day) AS integer), NULL FROM daily
UNION SELECT 'flow_daily:' || year(day) || '_' || month(day) || '_' || day(day) || ':' || loc, 'flow_daily', loc,
  cast(year(day) AS integer), cast(month(day) AS integer), day FROM daily""")
def parse(spark, d):
    day, loc = F.col("day"), F.col("loc")
    # as many tasks as the lines ask for, so that neither the days nor the distinct names of one grow with the table
    lines = read(spark, d, "lineitem").count()
    built = spread_rows(daily(spark, d, tasks=-(-lines // ROWS_PER_TASK)).select(F.explode(F.array(
        names.build_name("flow_mon", names.month_period(day), loc),
        names.build_name("flow_ann", F.year(day), loc),
        names.build_name("flow_mean_mon", F.month(day), loc),
        names.build_name("flow_daily", names.day_period(day), loc))).alias("name")), len(_KINDS) * lines, "name").distinct()
    n = F.col("name")
    parts = names.period_parts(n)
    return built.select("name", names.name_group(n).alias("grp"), names.name_location(n).alias("loc"),
                        *[c.alias(k) for k, c in parts.items()])


@check("P12_strip_flow_class", with_ctes("daily") + """
SELECT 'streamflow_daily:' || year(day) || '_' || month(day) || '_' || day(day) || ':' || loc AS name,
  'streamflow_mon:' || year(day) || ':' || loc AS other FROM daily""")
def strip(spark, d):
    day, loc = F.col("day"), F.col("loc")
    one = F.lit(3).cast("int")
    return daily(spark, d).select(
        names.strip_flow_class(names.daily_flow_name(one, one, day, loc)).alias("name"),
        names.strip_flow_class(names.build_name("streamflow_mon", F.year(day), loc)).alias("other"))


@check("P13_name_metadata", """
SELECT cast(event_id AS varchar) AS id, cast(user_id AS varchar) AS user_key, event_type AS kind,
 CASE WHEN event_id % 3 = 0 THEN cast(hour(ts) AS varchar) END AS hour_key FROM events""")
def metadata(spark, d):
    name = F.concat(
        F.lit("obs_id:"), F.col("event_id").cast("string"), F.lit("_usr:"), F.col("user_id").cast("string"),
        F.lit("_kind:old_note_kind:"), F.col("event_type"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("_hr:"), F.hour("ts").cast("string"))).otherwise(F.lit("")))
    m = names.metadata_map(name)
    return read(spark, d, "events").select(m.alias("m")).select(
        F.col("m")["id"].alias("id"), F.col("m")["usr"].alias("user_key"), F.col("m")["kind"].alias("kind"),
        F.col("m")["hr"].alias("hour_key"))


@check("A1_monthly_mean", with_ctes("daily") + f""", bins AS (
 SELECT loc, unnest(range((SELECT date_trunc('month', min(day)) FROM daily)::timestamp,
   (SELECT date_trunc('month', max(day)) + interval 1 day FROM daily)::timestamp, interval 1 month)) AS period
 FROM (SELECT DISTINCT loc FROM daily))
SELECT b.loc, cast(b.period AS date) AS period, {q_rnd('avg(value)')} AS value
FROM bins b LEFT JOIN daily d ON b.loc = d.loc AND date_trunc('month', d.day) = b.period GROUP BY 1, 2""")
def monthly(spark, d):
    return series.monthly_mean(daily(spark, d), densify=True).withColumn("value", rnd("value"))


_MONTHLY = with_ctes("daily") + """, monthly AS (
SELECT loc, cast(date_trunc('month', day) AS date) AS period, avg(value) AS value FROM daily GROUP BY 1, 2)
"""


@check("A2_mean_monthly", _MONTHLY + f"""
SELECT loc, cast(month(period) AS integer) AS month, {q_rnd('avg(value)')} AS value FROM monthly GROUP BY 1, 2""")
def climatology(spark, d):
    return series.mean_monthly(daily(spark, d)).withColumn("value", rnd("value"))


@check("A3_annual_mean", with_ctes("daily") + f"""
SELECT loc, cast(date_trunc('year', day) AS date) AS period, {q_rnd('avg(value)')} AS value FROM daily GROUP BY 1, 2""")
def annual(spark, d):
    return series.annual_mean(daily(spark, d)).withColumn("value", rnd("value"))


@check("A4_monthly_sum", with_ctes("daily") + f"""
SELECT loc, cast(date_trunc('month', day) AS date) AS period, {q_rnd('sum(value)')} AS value FROM daily GROUP BY 1, 2""")
def monthly_total(spark, d):
    return series.monthly_sum(daily(spark, d)).withColumn("value", rnd("value"))


@check("A5_min_max_normalise", with_ctes("daily") + f""", annual AS (
 SELECT loc, cast(date_trunc('year', day) AS date) AS period, avg(value) AS value FROM daily GROUP BY 1, 2)
SELECT loc, period, {q_rnd('(value - min(value) over ()) / (max(value) over () - min(value) over ())')} AS value FROM annual""")
def normalise(spark, d):
    return series.min_max_normalise(series.annual_mean(daily(spark, d))).withColumn("value", rnd("value"))


@check("A5_min_max_per_location", with_ctes("daily") + f""", annual AS (
 SELECT loc, cast(date_trunc('year', day) AS date) AS period, avg(value) AS value FROM daily GROUP BY 1, 2)
SELECT loc, period, {q_rnd('(value - min(value) over (partition by loc)) / nullif(max(value) over (partition by loc) - min(value) over (partition by loc), 0)')} AS value
FROM annual""")
def normalise_loc(spark, d):
    return series.min_max_normalise(series.annual_mean(daily(spark, d)), per=["loc"]).withColumn("value", rnd("value"))


def snow_input(spark, d):
    return (
        read(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("loc"), F.to_date("l_shipdate").alias("day"))
        .agg((F.max("l_discount") * 10).alias("extent"), (F.max("l_quantity") * 2).alias("clear_index"))
    )


@check("A6_snow_cover_bounds", f"""
WITH s AS (SELECT cast(l_suppkey AS varchar) AS loc, cast(l_shipdate AS date) AS day, max(l_discount) * 10 AS extent,
   max(l_quantity) * 2 AS clear_index FROM lineitem GROUP BY 1, 2),
c AS (SELECT loc, day, CASE WHEN clear_index >= 70 THEN clear_index / 100.0::double END AS ci, extent FROM s
   WHERE month(day) NOT IN (7, 8)),
m AS (SELECT loc, day, ci, CASE WHEN ci IS NOT NULL THEN extent END AS sca FROM c),
k AS (SELECT loc FROM m GROUP BY loc HAVING max(sca) > 0.5 AND count(CASE WHEN sca > 0 THEN 1 END) > 9),
y AS (SELECT loc FROM (SELECT loc, year(day) AS y, avg(sca) AS a FROM m GROUP BY 1, 2) WHERE a > 0 GROUP BY loc HAVING count(*) > 1)
SELECT loc, day, {q_rnd('ci * sca')} AS lower, {q_rnd('ci * sca + (1 - ci)')} AS upper
FROM m WHERE loc IN (SELECT loc FROM k) AND loc IN (SELECT loc FROM y)""")
def snow(spark, d):
    return series.snow_cover_bounds(snow_input(spark, d)).select("loc", "day", rnd("lower").alias("lower"),
                                                                 rnd("upper").alias("upper"))


@check("F1_user_diagnostic", with_ctes("daily_by_var") + f"""
SELECT loc, day, {q_rnd("max(CASE WHEN var = 'A' THEN value END) / (max(CASE WHEN var = 'A' THEN value END) + max(CASE WHEN var = 'N' THEN value END))")} AS value, 'share' AS var
FROM daily_by_var WHERE var IN ('A', 'N') GROUP BY loc, day""")
def user_diagnostic(spark, d):
    t = series.diagnostic(daily_by_var(spark, d), {"a": "A", "n": "N"}, lambda a, n: a / (a + n), "share")
    return t.withColumn("value", rnd("value"))
