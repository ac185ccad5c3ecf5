import numpy as np
import pytest
from pyspark.sql import functions as F

from brookcal.functions.variograms import Structure, Variogram
from brookcal.operators import data_worth as W
from brookcal.operators import ensembles as E
from brookcal.operators import pairs as X
from brookcal.operators import sampling as D
from brookcal.operators import spatial as G


def _ens(spark, n=30, names=12, seed=1):
    x = np.random.default_rng(seed).normal(2.0, 1.0, (n, names)) @ np.random.default_rng(2).normal(size=(names, names))
    rows = [("base" if i == 0 else str(i), f"o{j:02d}", float(x[i, j])) for i in range(n) for j in range(names)]
    return x, spark.createDataFrame(rows, "real string, name string, value double")


def test_blocked_covariance_with_many_tiles(spark):
    x, df = _ens(spark)
    left = E.deviations(df).select(F.col("name").alias("row"), F.col("real").alias("k"), F.col("value").alias("v"))
    got = {(r["row"], r["col"]): r["v"] / 29 for r in X.gram_product(left, dense=True, tile=3, inner=7).collect()}
    want = np.cov(x.T)
    assert len(got) == 78
    for (a, b), v in got.items():
        assert a <= b and np.isclose(v, want[int(a[1:]), int(b[1:])])


def test_sparse_product_keeps_only_shared_entries(spark):
    a = spark.createDataFrame([("r1", "k1", 2.0), ("r2", "k2", 3.0)], "row string, col string, v double")
    b = spark.createDataFrame([("k1", "c1", 5.0), ("k2", "c1", -1.0), ("k3", "c2", 4.0)], "row string, col string, v double")
    assert {tuple(r) for r in X.multiply(a, b).collect()} == {("r1", "c1", 10.0), ("r2", "c1", -3.0)}
    small = X.block_product(a.withColumnRenamed("col", "k"), b.withColumnRenamed("row", "k"), tile=1, inner=1)
    assert {tuple(r) for r in small.collect()} == {("r1", "c1", 10.0), ("r2", "c1", -3.0)}


def test_data_worth_matches_observation_space(spark):
    x, df = _ens(spark)
    n, names = x.shape
    d = (x - x.mean(axis=0)) / np.sqrt(n - 1)
    c = d.T @ d
    r = np.linspace(0.5, 2.0, names)
    groups = spark.createDataFrame([("g1", "o00"), ("g1", "o01"), ("g1", "o02"), ("g2", "o03"), ("g2", "o04")], "group string, name string")
    noise = spark.createDataFrame([(f"o{j:02d}", float(r[j])) for j in range(names)], "name string, var double")
    preds = spark.createDataFrame([("o10",), ("o11",)], "name string")
    std, means = W.posterior_moments(df, groups, noise, preds)
    got = {(q["group"], q["name"]): q["post_std"] for q in std.collect()}
    mean = {(q["group"], q["real"], q["name"]): q["mean"] for q in means.collect()}
    for group, at in {"g1": [0, 1, 2], "g2": [3, 4], "posterior": [0, 1, 2, 3, 4]}.items():
        inv = np.linalg.inv(c[np.ix_(at, at)] + np.diag(r[at]))
        for p in (10, 11):
            gain = c[at, p] @ inv
            assert np.isclose(got[(group, f"o{p}")] ** 2, c[p, p] - gain @ c[at, p])
            for i in (0, 7):
                want = x[:, p].mean() + gain @ (x[i, at] - x[:, at].mean(axis=0))
                assert np.isclose(mean[(group, "base" if i == 0 else str(i), f"o{p}")], want)


def test_group_conflict_matches_direct_leave_one_out(spark):
    x, df = _ens(spark, n=14, names=6)
    z = x.mean(axis=0) + 3.0
    obs = spark.createDataFrame([(f"o{j:02d}", float(z[j]), 1.0, "g") for j in range(6)], "obsnme string, obsval double, weight double, obgnme string")
    got = W.group_conflict(df, obs).collect()[0]
    ne = len(x)
    ns = ne - 1
    delta, v = 2.0 / (ns + 2.0), x.var(axis=0, ddof=1).mean()
    dx, dz = [], []
    for i in range(ne):
        xs = np.delete(x, i, axis=0)
        inv = np.linalg.inv(delta * v * (ns - 1) / (1 - delta) * np.eye(ns) + xs @ xs.T)
        for out, u in ((dx, x[i] - xs.mean(axis=0)), (dz, z - xs.mean(axis=0))):
            out.append((u @ u - (xs @ u) @ inv @ (xs @ u)) / (delta * v))
    mx, mz = np.median(dx), np.median(dz)
    assert np.isclose(got["z_score"], (mz - mx) / (1.4826 * np.median(np.abs(np.array(dx) - mx))))
    assert np.isclose(got["p_value"], 1 - np.argmin(np.abs(np.sort(dx) - mz)) / ne)


def test_draws_do_not_depend_on_partitioning(spark):
    t = spark.createDataFrame([(f"n{i}", float(i), 1.0) for i in range(50)], "name string, mean double, std double")
    a = {(r["real"], r["name"]): r["value"] for r in D.gaussian_draw(t.repartition(1), 20, 5).collect()}
    b = {(r["real"], r["name"]): r["value"] for r in D.gaussian_draw(t.repartition(9), 20, 5).collect()}
    assert a == b and len(set(a.values())) == 1000


def test_add_base_refuses_a_second_base(spark):
    _, df = _ens(spark, 4, 2)
    control = spark.createDataFrame([("o00", 1.0), ("o01", 2.0)], "name string, value double")
    with pytest.raises(Exception, match="already holds a base"):
        E.add_base(df, control).collect()
    out = E.add_base(df.where("real <> 'base'"), control)
    assert {r["real"] for r in out.collect()} == {"1", "2", "base"}


def test_renumber_orders_numbers_then_base(spark):
    ids = spark.createDataFrame([("10",), ("base",), ("2",), ("33",)], "real string")
    assert {r["real"]: r["new_real"] for r in E.renumber(ids).collect()} == {"2": "0", "10": "1", "33": "2", "base": "base"}


def test_nearest_points_on_a_hot_spot(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.uniform(0, 100, (150, 2)), 50 + rng.normal(0, 0.01, (300, 2)), np.tile([20.0, 20.0], (100, 1))])
    pts = spark.createDataFrame([(f"p{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(xy)], "name string, x double, y double")
    txy = rng.uniform(-5, 105, (25, 2))
    tgt = spark.createDataFrame([(f"t{i}", float(a), float(b)) for i, (a, b) in enumerate(txy)], "target string, x double, y double")
    got = {}
    for r in G.nearest_points(tgt, pts, 30.0, 6).collect():
        got.setdefault(r["target"], []).append((r["rank"], r["name"]))
    for i, (a, b) in enumerate(txy):
        d = np.sqrt((xy[:, 0] - a) ** 2 + (xy[:, 1] - b) ** 2)
        want = sorted((d[j], f"p{j:04d}") for j in range(len(d)) if d[j] <= 30.0)[:6]
        assert [n for _, n in sorted(got.get(f"t{i}", []))] == [n for _, n in want]


def test_near_duplicates_match_pairwise_rule(spark):
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.uniform(0, 20, (200, 2)), np.tile([5.0, 5.0], (150, 1))])
    pts = spark.createDataFrame([(f"p{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(xy)], "name string, x double, y double")
    got = [r["name"] for r in G.near_duplicates(pts, 0.9).collect()]
    want = {f"p{j:04d}" for j in range(len(xy)) if any(((xy[i] - xy[j]) ** 2).sum() < 0.81 for i in range(j))}
    assert len(got) == len(set(got)) and set(got) == want


def test_kriging_weights_match_a_direct_solve(spark):
    rng = np.random.default_rng(9)
    xy = rng.uniform(0, 50, (60, 2))
    pts = spark.createDataFrame([(f"p{i:02d}", float(a), float(b)) for i, (a, b) in enumerate(xy)], "name string, x double, y double")
    s = Structure((Variogram("exponential", 1.0, 15.0, 1.5, 20.0),), 0.2)
    tgt = spark.createDataFrame([("t", 25.0, 25.0), ("on", float(xy[0, 0]), float(xy[0, 1])), ("far", 900.0, 900.0)], "target string, x double, y double")
    w, err = G.kriging_weights(tgt, pts, s, 40.0, 8, remove_negative=False)
    got = {r["name"]: r["w"] for r in w.where("target = 't'").collect()}
    d = np.hypot(xy[:, 0] - 25, xy[:, 1] - 25)
    at = np.argsort(d)[:8]
    cov = lambda a, b: G._numpy_covariance(s, np.array(a[:, None, 0] - b[None, :, 0]), np.array(a[:, None, 1] - b[None, :, 1]))
    a = np.ones((9, 9))
    a[:8, :8] = cov(xy[at], xy[at]) + 0.2 * np.eye(8)
    a[8, 8] = 0
    rhs = np.append(cov(np.array([[25.0, 25.0]]), xy[at])[0] + 0.2, 1.0)
    f = np.linalg.solve(a, rhs)
    for j, k in enumerate(at):
        assert np.isclose(got[f"p{k:02d}"], f[j])
    e = {r["target"]: r["err_var"] for r in err.collect()}
    assert np.isclose(e["t"], 1.2 + f[8] - f[:8] @ rhs[:8]) and e["on"] == 0.2 and e["far"] == pytest.approx(1.2)


def test_correlated_draw_has_the_covariance_and_refuses_large_groups(spark):
    rng = np.random.default_rng(12)
    groups = {"g": 23, "h": 2}
    rows, full = [], {}
    for g, m in groups.items():
        a = rng.normal(size=(m, m))
        full[g] = a @ a.T + np.eye(m)
        rows += [(g, f"{g}{i:02d}", f"{g}{j:02d}", float(full[g][i, j])) for i in range(m) for j in range(i, m)]
    cov = spark.createDataFrame(rows, "group string, row string, col string, v double")
    names = [f"{g}{i:02d}" for g, m in groups.items() for i in range(m)]
    means = spark.createDataFrame([(x, 0.0) for x in names], "name string, mean double")
    x = D.correlated_draw(cov, means, 3000, 4).toPandas().pivot(index="real", columns="name", values="value")
    for g, m in groups.items():
        own = x[[f"{g}{i:02d}" for i in range(m)]].to_numpy()
        assert np.abs(np.cov(own.T) - full[g]).max() < 0.12 * np.abs(full[g]).max()
    with pytest.raises(Exception, match="23 names"):
        D.correlated_draw(cov, means, 10, 4, most=22).collect()


def test_data_worth_refuses_missing_variances_and_oversized_ensembles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    ens = spark.createDataFrame([(str(r), n, float(rng.normal())) for r in range(12) for n in ("a", "b", "p")], "real string, name string, value double")
    groups = spark.createDataFrame([("g", "a"), ("h", "b")], "`group` string, name string")
    predictions = spark.createDataFrame([("p",)], "name string")
    both = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, var double")
    std, _ = W.posterior_moments(ens, groups, both, predictions, first_moment=False)
    assert {r["group"] for r in std.collect()} == {"g", "h", "posterior"}
    with pytest.raises(Exception, match="no noise variance for b"):
        W.posterior_moments(ens, groups, both.where("name = 'a'"), predictions, first_moment=False)[0].collect()
    monkeypatch.setattr(W, "MOST_REALIZATIONS", 11)
    with pytest.raises(Exception, match="12 realizations"):
        W.posterior_moments(ens, groups, both, predictions, first_moment=False)[0].collect()


def test_chunks_of_the_inner_dimension_add_up(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(40, 7))
    m[rng.random(m.shape) < 0.6] = 0.0
    entries = [(f"r{j}", f"k{i:02d}", float(m[i, j])) for i in range(40) for j in range(7) if m[i, j]]
    rows = spark.createDataFrame(entries, "row string, k string, v double")
    got = {(r["row"], r["col"]): r["v"] for r in X.gram_product(rows, tile=3, inner=2).collect()}
    want = {(f"r{i}", f"r{j}"): float(m[:, i] @ m[:, j]) for i in range(7) for j in range(i, 7) if (m[:, i] * m[:, j]).any()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_large_ensembles_are_solved_in_observation_space(spark, monkeypatch):
    """The same results as in realization space; ensembles of more realizations than one task solves for were refused."""
    x, df = _ens(spark, n=14, names=8)
    groups = spark.createDataFrame([("g1", "o00"), ("g1", "o01"), ("g1", "o02"), ("g2", "o03"), ("g2", "o07")], "group string, name string")
    noise = spark.createDataFrame([(f"o{j:02d}", 0.5 + j) for j in range(8)], "name string, var double")
    # one prediction is an observation too, one realization lacks a name
    preds = spark.createDataFrame([("o06",), ("o07",)], "name string")
    some = df.where("real <> '3' OR name <> 'o01'")
    obs = spark.createDataFrame([(f"o{j:02d}", float(x[:, j].mean() + j), 1.0, f"g{j % 2}") for j in range(8)], "obsnme string, obsval double, weight double, obgnme string")
    runs = some.withColumn("run", F.lit("a")).unionByName(some.where("real < '5'").withColumn("run", F.lit("b")))

    def results():
        std, means = W.posterior_moments(some, groups, noise, preds)
        apart, _ = W.posterior_moments(runs, groups, noise, preds)
        return [sorted(tuple(r) for r in t.collect()) for t in (std, means, apart, W.group_conflict(some, obs))]

    want = results()
    # run b stays in realization space
    monkeypatch.setattr(W, "IN_REALIZATION_SPACE", 9)
    monkeypatch.setattr(W, "CHUNK", 4)
    for w, g in zip(want, results()):
        assert len(w) == len(g) > 0
        for a, b in zip(w, g):
            assert all(np.isclose(p, q, rtol=1e-8, atol=1e-10) if isinstance(p, float) else p == q for p, q in zip(a, b)), (a, b)
    monkeypatch.setattr(W, "MOST_OBSERVATIONS", 2)
    with pytest.raises(Exception, match="observations of a group are more than the 2"):
        W.posterior_moments(some, groups, noise, preds)[0].collect()


def test_plans_of_data_worth_do_not_repeat_the_plans_of_their_inputs(spark, monkeypatch, tmp_path):
    """Each place that read an input held its whole plan, and the driver ran out of memory over them."""
    _, df = _ens(spark, n=14, names=4)
    tables = {
        "ens": df, "groups": spark.createDataFrame([("g1", "o00"), ("g2", "o01")], "group string, name string"),
        "noise": spark.createDataFrame([(f"o{j:02d}", 0.5 + j) for j in range(4)], "name string, var double"),
        "predictions": spark.createDataFrame([("o02",), ("o03",)], "name string")}
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}")
    for most in (5000, 9):
        monkeypatch.setattr(W, "IN_REALIZATION_SPACE", most)
        results = W.posterior_moments(*[spark.read.parquet(f"{tmp_path}/{name}") for name in tables])
        assert [t.count() for t in results] == [3 * 2, 3 * 14 * 2]
        assert not any("FileScan" in t._jdf.queryExecution().executedPlan().toString() for t in results)
