import numpy as np
from pyspark.sql import functions as F

from brookcal.functions.order_stats import CELL, _cell, descending_rank, exact_quantiles, value_bucket
from brookcal.functions.ordering import global_row_number, lead_in_group, number_in_group


def _skewed(spark, seed=3):
    """One key holds most rows and many ties; values span signs and magnitudes."""
    rng = np.random.default_rng(seed)
    rows = [("hot", float(v)) for v in np.concatenate([np.zeros(400), np.round(rng.normal(0, 50, 900), 1), 10 ** rng.uniform(-6, 9, 300)])]
    rows += [(k, float(v)) for k in "abc" for v in rng.normal(5, 2, 7)]
    rows += [("null", None), ("null", 4.0)]
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_exact_quantiles_match_numpy_on_skewed_keys(spark):
    rows, df = _skewed(spark)
    probs = {"q0": 0.0, "q05": 0.05, "q5": 0.5, "q75": 0.75, "q1": 1.0}
    for method in ("linear", "nearest"):
        got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs, method).collect()}
        for key in {k for k, _ in rows}:
            v = np.array([x for k, x in rows if k == key and x is not None])
            for name, p in probs.items():
                assert np.isclose(got[key][name], np.quantile(v, p, method=method), rtol=1e-12, atol=1e-12), (key, name, method)


def test_descending_rank_is_a_row_number(spark):
    rng = np.random.default_rng(5)
    days = np.datetime64("1999-11-20") + np.arange(500)
    flows = np.round(rng.gamma(0.5, 3.0, 500), 0) - 1.0
    df = spark.createDataFrame([("g", str(d), float(q)) for d, q in zip(days, flows)], "loc string, day string, q double").withColumn("day", F.to_date("day"))
    got = {str(r["day"]): r["rank"] for r in descending_rank(df, "loc", "q", "day").collect()}
    order = sorted([(q, str(d)) for d, q in zip(days, flows) if q > 0], reverse=True)
    assert {d: i + 1 for i, (_, d) in enumerate(order)} == {d: r for d, r in got.items() if r is not None}


def test_ordered_chunks_number_and_lead_across_ranges(spark):
    rows = [("hot", f"n{i:05d}") for i in range(3000)] + [("b", "x"), ("c", "y"), ("c", "z")]
    df = spark.createDataFrame(rows, "g string, n string").repartition(7)
    assert [r["row_number"] for r in global_row_number(df, ["g", "n"]).orderBy("g", "n").collect()] == list(range(1, 3004))
    lead = {(r["g"], r["n"]): r["next_n"] for r in lead_in_group(df, "g", "n", ["n"]).collect()}
    for (g, n), (g2, n2) in zip(sorted(rows), sorted(rows)[1:] + [(None, None)]):
        assert lead[(g, n)] == (n2 if g2 == g else None)
    assert {r["n"]: r["row_number"] for r in number_in_group(df, "g", ["n"]).where("g <> 'hot'").collect()} == {"x": 0, "y": 0, "z": 1}


def test_nan_is_missing(spark):
    rows = [(v,) for v in (-3.0, -2.0, -1.0, 1.0, 2.0, float("nan"), None)]
    df = spark.createDataFrame(rows, "value double").selectExpr("'k' AS key", "value")
    got = exact_quantiles(df, ["key"], "value", {"median": 0.5, "most": 1.0}).first()
    assert (got["median"], got["most"]) == (-1.0, 2.0)


def _awkward(rng):
    """Values in a narrow range, tiny ones, equal ones, infinite ones."""
    return {
        "narrow": 1e6 + np.arange(10_000) * 1e-3, "tiny": 10 ** rng.uniform(-300, -8, 10_000), "below": -1e6 - rng.uniform(0, 1, 10_000),
        "equal": np.full(5_000, 3.25), "ends": np.array([-np.inf, -1.0, 0.0, 5e-324, 2.0, 1.7e308, np.inf]),
    }


def test_quantiles_of_narrow_tiny_and_equal_values(spark):
    series = _awkward(np.random.default_rng(8))
    df = spark.createDataFrame([(k, float(x)) for k, v in series.items() for x in v], "k string, v double").repartition(5)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}, "nearest").collect()}
    for k, v in series.items():
        assert [got[k][c] for c in ("lo", "mid", "hi")] == [np.quantile(v, p, method="nearest") for p in (0.1, 0.5, 0.9)]
    rank = descending_rank(df.withColumn("day", F.lit("2001-01-01").cast("date")).where("k = 'narrow'"), "k", "v", "day")
    top = rank.orderBy("rank").select("v").collect()
    assert [r["v"] for r in top] == sorted(series["narrow"], reverse=True)


def test_no_cell_holds_many_values_and_buckets_keep_the_order(spark):
    series = _awkward(np.random.default_rng(9))
    df = spark.createDataFrame([(k, float(x)) for k, v in series.items() for x in v], "k string, v double")
    b = df.withColumn("b", value_bucket(F.col("v")))
    stats = b.groupBy("k", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cells = b.join(stats, ["k", "b"]).withColumn("s", _cell(F.col("v"), F.col("lo"), F.col("hi"), F.col("n")))
    assert cells.groupBy("k", "b", "s").agg(F.count_distinct("v").alias("d")).agg(F.max("d")).first()[0] < 2 * CELL
    for k in series:
        rows = [(r["v"], r["b"], r["s"]) for r in cells.where(F.col("k") == k).collect()]
        places = [x[1:] for x in sorted(rows)]
        assert places == sorted(places)
