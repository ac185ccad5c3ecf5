import pytest
from pyspark.sql import functions as F

from brookcal.functions import metrics
from brookcal.operators import observations as O
from brookcal.operators import parameters as P
from brookcal.operators import scoring as S
from brookcal.operators import series

NOISE = [("streamflow_daily_low  ", 0.1, 1e11, 0.15), ("streamflow_nodata", 0.1, 1e11, 0.0), ("l_max_actet_mon ", 0.001, 1e11, 0.2)]


def _noise(spark):
    return spark.createDataFrame(NOISE, "obsgroup string, noise_percent double, obsubnd double, wt_percent double")


def test_excluded_gauge_with_small_value_regains_weight_one(spark):
    obs = spark.createDataFrame(
        [("streamflow_daily_4_1:2000_1_1:01", 0.5), ("streamflow_daily_4_1:2000_1_1:02", 5.0), ("streamflow_daily_4_1:2000_1_2:01", 9.0),
         ("streamflow_daily_4_1:2000_1_3:02", -9999.0), ("l_max_actet_mon:2000_1:7", 0.4)], "obsnme string, obsval double")
    gauges = spark.createDataFrame([("01",)], "loc string")
    t = O.assign_groups(obs, gauges)
    w = {r["obsnme"]: r["weight"] for r in O.initial_weights(t, _noise(spark)).collect()}
    assert w["streamflow_daily_4_1:2000_1_1:01"] == 1.0
    assert w["streamflow_daily_4_1:2000_1_1:02"] == 2.0
    assert w["streamflow_daily_4_1:2000_1_2:01"] == 0.0
    assert w["streamflow_daily_4_1:2000_1_3:02"] == 0.0
    assert w["l_max_actet_mon:2000_1:7"] == 5.0
    strict = {r["obsnme"]: r["weight"] for r in O.initial_weights(t, _noise(spark), strict_nodata=True).collect()}
    assert strict["streamflow_daily_4_1:2000_1_1:01"] == 0.0


def _res(spark):
    rows = [
        ("a1", "l_max_x", 10.0, 12.0, 1.0), ("a2", "l_max_x", 10.0, 9.0, 1.0), ("b1", "g_min_x", 10.0, 12.0, 2.0), ("b2", "g_min_x", 10.0, 7.0, 2.0),
        ("c1", "flow", 5.0, 4.0, 0.0), ("c2", "flow", 5.0, 8.0, 0.0), ("d1", "zero", 1.0, 1.0, 3.0)]
    return spark.createDataFrame(rows, "name string, `group` string, measured double, modelled double, weight double")


def test_phi_honours_bounds(spark):
    assert {r["group"]: r["phi"] for r in S.phi_with_total(_res(spark)).collect()} == {"l_max_x": 4.0, "g_min_x": 36.0, "flow": 0.0, "zero": 0.0, "total": 40.0}


def test_reweighting_reaches_targets_and_keeps_edge_groups(spark):
    t = S.targets_from({"l_max_x": 25.0, "g_min_x": 0.0, "flow": 40.0, "zero": 7.0}, spark)
    out = S.reweight_groups(_res(spark), t)
    phi = {r["group"]: r["phi"] for r in S.phi_components(out).collect()}
    assert phi["l_max_x"] == pytest.approx(25.0) and phi["g_min_x"] == 0.0 and phi["flow"] == pytest.approx(40.0) and phi["zero"] == 0.0
    assert {r["weight"] for r in out.where("`group` = 'zero'").collect()} == {3.0}


def test_discrepancy_ceiling_and_group_error(spark):
    w = {r["name"]: r["weight"] for r in S.discrepancy_weights(_res(spark)).collect()}
    assert w["a1"] == pytest.approx(0.5) and w["a2"] == 1.0 and w["b2"] == pytest.approx(2.0 / 6.0) and w["c1"] == 0.0
    free = {r["name"]: r["weight"] for r in S.discrepancy_weights(_res(spark), original_ceiling=False).collect()}
    assert free["d1"] == float("inf")


def test_metrics_by_name_and_unknown_names(spark):
    assert [c for c in S.fit_metrics(_res(spark), "rmse").columns] == ["group", "rmse"]
    with pytest.raises(ValueError):
        metrics.resolve(["rmse", "nonsense"])


def test_nan_never_counts_as_valid(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "v double")
    assert [r[0] for r in df.select(series.fill_missing(F.col("v"))).collect()] == [-9999.0, -9999.0, 2.0]


def test_percent_bounds_invert_for_negative_values(spark):
    pars = spark.createDataFrame([("p:hru_1", -10.0), ("r:hru_1", 3.0)], "parnme string, parval1 double")
    table = spark.createDataFrame([("p", "Percent", 0.0, 1.0), ("r", "Range", 0.0, 9.0)], "parameter_name string, method string, par_lower_bound double, par_upper_bound double")
    t = P.bounds_by_method(pars, table)
    assert {(r["parnme"], r["parlbnd"], r["parubnd"]) for r in t.collect()} == {("p:hru_1", -8.0, -12.0), ("r:hru_1", 0.0, 9.0)}
    assert P.inverted_bounds(t).count() == 1


def test_expansion_rejects_a_shape_mismatch(spark):
    bad = spark.createDataFrame([("p", [1, 2], [[1.0]])], "par string, ids array<int>, values array<array<double>>")
    with pytest.raises(Exception, match="differ in length"):
        P.expand(bad).collect()


def test_long_ids_and_missing_parts_stay(spark):
    from pyspark.sql import functions as F

    from brookcal.functions import names

    df = spark.createDataFrame([("54310157",), ("054310157",), ("7",), (None,)], "loc string")
    got = [tuple(r) for r in df.select(names.pad_id(F.col("loc"), 8), names.build_name("g", F.lit("2000_1"), F.col("loc"))).collect()]
    assert got == [
        ("54310157", "g:2000_1:54310157"), ("054310157", "g:2000_1:054310157"), ("00000007", "g:2000_1:7"), (None, None),
    ]


def test_barriers_without_multiplier_stay(spark):
    from brookcal.operators import multipliers

    columns = "lay int, irow1 int, icol1 int, irow2 int, icol2 int, hydchr double"
    barriers = spark.createDataFrame([(1, 1, 1, 2, 1, 4.0), (1, 5, 1, 6, 1, 3.0)], columns)
    got = multipliers.barrier_multipliers(barriers, spark.createDataFrame([(1, 1, 1, 2, 1, 0.5)], columns)).collect()
    assert sorted((r["irow1"], r["hydchr"]) for r in got) == [(1, 2.0), (5, 3.0)]


def test_lines_a_scan_leaves_out_are_reported(spark, tmp_path):
    from brookcal.sources import text

    files = {
        "pairs": (["name obsval", "a 1.0", "b", "c 1.x", "d na", "", "e 2.0 note"], ["b", "c 1.x"]),
        "parameter_values": (["single point", "p 1.0 1.0 0.0", "q 1.0 1.0", "r 1 one 0"], ["q 1.0 1.0", "r 1 one 0"]),
        "site_samples": (["s 01/02/2000 00:00:00 1.5", "s 01/02/2000 00:00:00 dry", "s 01/02/2000 1.5", "s 41/42/2000 00:00:00 1.5"],
                         ["s 01/02/2000 1.5", "s 41/42/2000 00:00:00 1.5"]),
        "pilot_points": (["p 1.0 2.0 1 3.0", "p 1.0 2.0 3.0", "p 1.0 2.0 1 none"], ["p 1.0 2.0 3.0", "p 1.0 2.0 1 none"]),
        "residuals": ([" OUTPUT", "Name Group Measured Modelled Residual Weight", "a g 1 2 -1 1", "b g 1 2 Cov. 1", "c g 1 2", "d g 1 two -1 1"],
                      ["c g 1 2", "d g 1 two -1 1"]),
    }
    for kind, (lines, bad) in files.items():
        (tmp_path / f"{kind}.txt").write_text("\n".join(lines) + "\n")
        assert sorted(r["value"] for r in text.rejected_lines(spark, str(tmp_path / f"{kind}.txt"), kind).collect()) == sorted(bad)
    with pytest.raises(ValueError, match="unknown format"):
        text.rejected_lines(spark, str(tmp_path), "other")


def test_change_limits_start_from_the_original_value(spark):
    rows = [("a", "none", "factor", 1e-6, 0.0, 10.0, 2.0), ("b", "log", "factor", 1e-6, 0.0, 10.0, 2.0), ("c", "none", "relative", -4.0, -9.0, 9.0, -4.0),
            ("d", "none", "factor", -4.0, -99.0, 9.0, -4.0)]
    pars = spark.createDataFrame(rows, "parnme string, partrans string, parchglim string, parval1 double, parlbnd double, parubnd double, start double")
    got = {r["parnme"]: (r["chg_lower"], r["chg_upper"]) for r in P.change_limits(pars, 10.0, 0.5, "start").collect()}
    want = {"a": (2e-4, 2e-2), "b": (1e-7, 1e-5), "c": (-6.0, -2.0), "d": (-40.0, -0.4)}
    assert all(got[k] == pytest.approx(want[k]) for k in want)
