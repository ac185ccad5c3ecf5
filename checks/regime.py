from __future__ import annotations

from pyspark.sql import functions as F

from brookcal.functions import names
from brookcal.operators import regime
from checks.registry import check, q_rnd, rnd
from checks.views import daily, gauge_flow, with_ctes

_RANKED = with_ctes("gauge_flow", recursive=True) + """, pos AS (
 SELECT loc, day, discharge, row_number() OVER (PARTITION BY loc ORDER BY discharge DESC, day DESC) AS rk,
   row_number() OVER (PARTITION BY loc ORDER BY discharge, day) AS rn, count(*) OVER (PARTITION BY loc) AS n
 FROM gauge_flow WHERE discharge > 0),
cuts AS (SELECT loc, max(CASE WHEN rn - 1 = round_even((n - 1) * 0.1, 0) THEN discharge END) AS p10,
   max(CASE WHEN rn - 1 = round_even((n - 1) * 0.5, 0) THEN discharge END) AS median,
   max(CASE WHEN rn - 1 = round_even((n - 1) * 0.75, 0) THEN discharge END) AS p75 FROM pos GROUP BY loc),
nbr AS (SELECT f.loc, f.day, f.discharge AS q, p.discharge AS prev_q, p.day IS NOT NULL AS has_prev, x.discharge AS next_q
 FROM gauge_flow f LEFT JOIN gauge_flow p ON f.loc = p.loc AND p.day = f.day - 1
 LEFT JOIN gauge_flow x ON f.loc = x.loc AND x.day = f.day + 1),
fst AS (SELECT loc, min(day) AS first_day FROM nbr WHERE q >= 0 AND next_q >= 0 GROUP BY loc)"""

_STATES = _RANKED + """, opening AS (
 SELECT f.loc, f.first_day, CASE WHEN n.next_q < n.q * 0.75 THEN 3
   WHEN coalesce(n.q > c.median, false) OR n.next_q >= n.q * 1.25 THEN 2 ELSE 1 END AS s0
 FROM fst f JOIN nbr n ON n.loc = f.loc AND n.day = f.first_day LEFT JOIN cuts c ON c.loc = f.loc),
cal AS (SELECT o.loc, d.day, o.first_day, o.s0, n.q, n.prev_q, c.median, c.p75
 FROM opening o CROSS JOIN (SELECT unnest(generate_series((SELECT min(day) FROM gauge_flow), (SELECT max(day) FROM gauge_flow), interval 1 day))::date AS day) d
 LEFT JOIN nbr n ON n.loc = o.loc AND n.day = d.day LEFT JOIN cuts c ON c.loc = o.loc),
walk AS (
 SELECT loc, day, -1 AS s FROM cal WHERE day = (SELECT min(day) FROM gauge_flow) AND day < first_day
 UNION ALL SELECT loc, day, s0 FROM cal WHERE day = first_day AND day = (SELECT min(day) FROM gauge_flow)
 UNION ALL
 SELECT c.loc, c.day, CASE WHEN c.day < c.first_day THEN -1 WHEN c.day <= c.first_day + 1 THEN c.s0
   WHEN c.q IS NULL OR c.q < 0 THEN -1
   WHEN coalesce(c.q < c.median, false) THEN 1
   WHEN w.s = 1 THEN CASE WHEN coalesce(c.q > c.p75, false) OR (coalesce(c.q > c.median, false) AND c.q > c.prev_q * 1.25) THEN 2 ELSE 1 END
   WHEN w.s = 2 THEN CASE WHEN c.q > c.prev_q * 0.9 THEN 2 ELSE 3 END
   WHEN w.s = 3 THEN CASE WHEN coalesce(c.q > c.p75, false) THEN 3 WHEN c.q < c.prev_q * 0.9 THEN 1 ELSE 3 END
   ELSE -1 END
 FROM walk w JOIN cal c ON c.loc = w.loc AND c.day = w.day + 1),
states AS (SELECT g.loc, g.day, g.discharge, CASE WHEN o.loc IS NULL THEN 0 ELSE w.s END AS high_low
 FROM gauge_flow g LEFT JOIN opening o ON o.loc = g.loc LEFT JOIN walk w ON w.loc = g.loc AND w.day = g.day)"""

_CLASSES = _STATES + """, classes AS (
SELECT s.loc, s.day, s.discharge, CASE WHEN high_low <> 0 THEN (p.n / 365.0::double + 1) / p.rk END AS ri, high_low,
 CASE WHEN high_low = 0 THEN 0
  WHEN s.discharge >= 0 AND high_low > 1 THEN CASE WHEN (p.n / 365.0::double + 1) / p.rk > 10 THEN 1 WHEN (p.n / 365.0::double + 1) / p.rk > 2 THEN 2 ELSE 3 END
  WHEN s.discharge >= 0 AND high_low = 1 THEN CASE WHEN s.discharge < c.p10 THEN 5 ELSE 4 END ELSE -1 END AS efc
FROM states s LEFT JOIN pos p ON p.loc = s.loc AND p.day = s.day LEFT JOIN cuts c ON c.loc = s.loc)"""


@check("W1_recurrence_interval", _RANKED + f"""
SELECT g.loc, g.day, g.discharge, {q_rnd('(p.n / 365.0::double + 1) / p.rk')} AS ri
FROM gauge_flow g LEFT JOIN pos p ON p.loc = g.loc AND p.day = g.day""")
def recurrence(spark, d):
    return regime.recurrence_interval(gauge_flow(spark, d)).select("loc", "day", "discharge", rnd("ri").alias("ri"))


@check("W2_nearest_rank_quantiles", _RANKED + "SELECT loc, p10, median, p75 FROM cuts")
def thresholds(spark, d):
    return regime.flow_thresholds(gauge_flow(spark, d))


@check("W3_first_valid_day", _RANKED + "SELECT loc, first_day FROM fst")
def first_valid(spark, d):
    return regime.first_valid_day(gauge_flow(spark, d))


@check("W4_limb_states", _STATES + "SELECT loc, day, discharge, cast(high_low AS integer) AS high_low FROM states")
def limbs(spark, d):
    return regime.limb_states(gauge_flow(spark, d))


@check("W5_flow_class", _CLASSES + f"""
SELECT loc, day, discharge, {q_rnd('ri')} AS ri, cast(high_low AS integer) AS high_low, cast(efc AS integer) AS efc FROM classes""")
def classes(spark, d):
    return regime.classify_flow(gauge_flow(spark, d)).withColumn("ri", rnd("ri"))


@check("W6_coarse_class", _CLASSES + """
SELECT loc, day, cast(CASE WHEN efc BETWEEN 1 AND 3 THEN 6 WHEN efc BETWEEN 4 AND 5 THEN 7 WHEN efc < 0 THEN 0 ELSE efc END AS integer) AS coarse
FROM classes""")
def coarse(spark, d):
    return regime.classify_flow(gauge_flow(spark, d)).select(
        "loc", "day", regime.coarse_class(F.col("efc"), F.col("discharge")).alias("coarse"))


@check("W7_water_year", with_ctes("daily") + f"""
SELECT loc, cast(year(day) + CASE WHEN month(day) > 9 THEN 1 ELSE 0 END AS integer) AS water_year, {q_rnd('avg(value)')} AS value
FROM daily GROUP BY 1, 2""")
def water_years(spark, d):
    return daily(spark, d).groupBy("loc", regime.water_year(F.col("day")).alias("water_year")).agg(
        rnd(F.avg("value")).alias("value"))


@check("J2_flow_with_regime", _CLASSES + """
SELECT 'streamflow_daily_' || efc || '_' || high_low || ':' || year(day) || '_' || month(day) || '_' || day(day) || ':' || loc AS obsnme,
 discharge AS obsval FROM classes""")
def flow_names(spark, d):
    flow = gauge_flow(spark, d)
    labels = regime.classify_flow(flow).select("loc", "day", "efc", "high_low")
    joined = flow.join(labels, ["loc", "day"])
    return joined.select(
        names.daily_flow_name(F.col("efc"), F.col("high_low"), F.col("day"), F.col("loc")).alias("obsnme"),
        F.col("discharge").alias("obsval"))
