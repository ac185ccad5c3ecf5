"""Packed blocks and pairs that pass a threshold."""

import numpy as np
import pytest

from brookcal.operators import pairs as X


def table(spark, matrix, keep=None):
    rows = [(f"n{i:03d}", f"k{j:03d}", float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r) if keep is None or keep[i, j]]
    return spark.createDataFrame(rows, "row string, k string, v double")


def test_entries_are_shuffled_once_whatever_the_number_of_blocks(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 30))
    rows = table(spark, m)
    for tile in (40, 5):
        n = X._tile_counts(rows, {"row": tile, "k": 10})
        from pyspark.sql import functions as F
        entries = rows.select(F.col("row").alias("_a"), F.col("k").alias("_k"), F.col("v").alias("_v"),
                              X._bucket("row", F.get(n, F.lit(0))).alias("_b"), X._bucket("k", F.get(n, F.lit(1))).alias("_kc"))
        packed = X._packed(entries, [])
        assert packed.select(F.explode("v")).count() == m.size
        # what is copied to tiles are packed rows without a string per entry
        assert packed.count() <= entries.select("_b", "_kc").distinct().count()
        assert packed.agg(F.max(F.size("names") + F.size("ks"))).collect()[0][0] <= 70
    got = {(r["row"], r["col"]): r["v"] for r in X.gram_product(rows, dense=True, tile=5, inner=10).collect()}
    want = m @ m.T
    assert len(got) == 40 * 41 // 2
    assert all(abs(v - want[int(a[1:]), int(b[1:])]) < 1e-9 for (a, b), v in got.items())


@pytest.mark.parametrize("least", [0.5, 3.0, 1e9])
def test_hits_by_norm_skip_tiles(spark, least):
    """Lengths over four orders of magnitude: tiles of short names are not formed, and no hit is lost."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 12)) * np.exp(rng.uniform(-8, 1, (60, 1)))
    keep = rng.uniform(size=m.shape) < 0.5
    rows = table(spark, m, keep)
    full = np.where(keep, m, 0)
    product, shared = full @ full.T, (keep.astype(int) @ keep.T.astype(int)) > 0
    want = {(f"n{i:03d}", f"n{j:03d}"): product[i, j] for i in range(60) for j in range(i + 1, 60) if shared[i, j] and abs(product[i, j]) >= least}
    hits = X.gram_hits(rows, lambda v, a, b: (np.abs(v) >= least, v), least, dense=False, tile=6, inner=5)
    got = {(r["row"], r["col"]): r["v"] for r in hits.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    formed = X.reaching_tiles(rows, least, tile=6, inner=5).select("_bi", "_bj").distinct().count()
    everything = X.reaching_tiles(rows, None, tile=6, inner=5).select("_bi", "_bj").distinct().count()
    assert everything == 55 and formed < everything * (0.8 if least < 1e6 else 0.01)


def test_correlated_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 40))
    x = np.vstack([base[i % 3] + 0.5 * rng.normal(size=40) for i in range(20)] + [np.ones(40)])
    ens = spark.createDataFrame([(f"r{j}", f"n{i:02d}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "real string, name string, value double")
    r = np.corrcoef(x[:20])
    want = {(f"n{i:02d}", f"n{j:02d}"): r[i, j] for i in range(20) for j in range(i + 1, 20) if r[i, j] >= 0.6}
    got = {(p["row"], p["col"]): p["v"] for p in X.correlated_pairs(ens, 0.6).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_competition_with_a_parameter_shared_by_all(spark):
    """One parameter is in every row: its products are formed in tiles, never as a row for each pair and parameter."""
    n = 70
    jac = spark.createDataFrame([(f"o{i:02d}", "all", 1.0 + i) for i in range(n)] + [(f"o{i:02d}", f"p{i % 7}", 2.0) for i in range(n)], "obs string, par string, v double")
    obs = spark.createDataFrame([(f"o{i:02d}", 0.0 if i == 3 else 1.0) for i in range(n)], "obsnme string, weight double")
    value = {(i, j): (1 + i) * (1 + j) + (4 if i % 7 == j % 7 else 0) for i in range(n) for j in range(i + 1, n) if 3 not in (i, j)}
    got = {(int(r["row"][1:]), int(r["col"][1:])): r["v"] for r in X.observation_competition(jac, obs).where("row < col").collect()}
    assert got == value
    strong = {(int(r["row"][1:]), int(r["col"][1:])): r["v"] for r in X.observation_competition(jac, obs, 3_000).collect()}
    assert strong == {k: v for k, v in value.items() if v >= 3_000}


def test_no_entries(spark):
    none = table(spark, np.zeros((0, 0)))
    assert X.gram_product(none).count() == 0
    assert X.gram_hits(none, lambda v, a, b: (v > 0, v), 1.0).count() == 0
