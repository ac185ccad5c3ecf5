"""Steps that must not grow faster than their input."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from brookcal.functions.variograms import Structure, Variogram
from brookcal.operators import sampling as D
from brookcal.operators import spatial as G
from brookcal.operators.noise import noise_draw


def test_neighbour_search_sends_no_cells_through_the_driver(spark, tmp_path, capsys):
    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 100, (600, 2))
    spark.createDataFrame([(f"p{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(xy)], "name string, x double, y double").write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    targets = points.where("name < 'p040'").select(F.col("name").alias("target"), (F.col("x") + 0.5).alias("x"), "y")
    found = G.nearest_points(targets, points, 20.0, 3, levels=2)
    got = {(r["target"], r["rank"]): r["name"] for r in found.collect()}
    for i in range(40):
        d = np.hypot(*(xy - xy[i] - [0.5, 0.0]).T)
        want = [f"p{j:03d}" for j in np.argsort(d) if d[j] <= 20.0][:3]
        assert [got[f"p{i:03d}", r] for r in range(1, len(want) + 1)] == want
    capsys.readouterr()
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_box_join_meets_each_pair_once(spark):
    rng = np.random.default_rng(9)
    a, b = rng.uniform(-50, 50, (60, 2)).round(), rng.uniform(-50, 50, (80, 2)).round()
    targets = spark.createDataFrame([(f"t{i}", i % 2, float(x), float(y)) for i, (x, y) in enumerate(a)], "target string, zone int, tx double, ty double")
    points = spark.createDataFrame([(f"p{i}", i % 2, float(x), float(y)) for i, (x, y) in enumerate(b)], "name string, zone int, x double, y double")
    got = sorted((r["target"], r["name"]) for r in G.within_box(targets, points, 7.0, ["zone"]).collect())
    assert got == sorted((f"t{i}", f"p{j}") for i in range(60) for j in range(80) if i % 2 == j % 2 and np.abs(a[i] - b[j]).max() < 7.0)


def test_line_files_grow_in_number(spark, monkeypatch):
    import checks

    checks.load()
    from checks import sources as S

    monkeypatch.setattr(S, "LINES", 10)
    path = S.spread_lines(spark, spark.range(95).select(F.concat(F.lit("l"), "id").alias("value")), ["head"], "lines")
    lines = spark.read.text(path)
    files = lines.groupBy(F.input_file_name()).agg(F.count_if(F.col("value") == "head").alias("n")).collect()
    assert len(files) == 10 and all(f["n"] == 1 for f in files)
    assert sorted(r["value"] for r in lines.where("value <> 'head'").collect()) == sorted(f"l{i}" for i in range(95))


def test_draws_of_a_table_in_one_partition_are_spread(spark):
    pars = spark.createDataFrame(
        [(f"p{i}", "log" if i % 2 else "none", 2.0, 1.0, 4.0) for i in range(40)], "parnme string, partrans string, parval1 double, parlbnd double, parubnd double").coalesce(1)
    draws = D.parameter_draw(pars, 50, 3, default="triangular")
    assert draws.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    again = D.parameter_draw(pars.repartition(5), 50, 3, default="triangular")
    assert draws.count() == 2000 and draws.exceptAll(again).isEmpty() and draws.where("value NOT BETWEEN 1 AND 4").isEmpty()


def test_noise_of_a_short_table_is_drawn_in_chunks_and_once(spark, capsys):
    obs = spark.createDataFrame([(f"n{i:02d}", "g", float(i), 1.0 if i % 3 else 0.0) for i in range(60)], "obsnme string, obgnme string, obsval double, weight double").coalesce(1)
    series = obs.where("weight > 0").select("obsnme", F.lit("s").alias("series"), F.col("obsval").alias("t"))
    draws = noise_draw(obs, series, Structure((Variogram("exponential", 1.0, 5.0),)), 8, 3)
    assert draws.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    capsys.readouterr()
    draws.explain()
    assert "size(transform" not in capsys.readouterr().out
    assert draws.count() == 480


def test_products_of_near_points_travel_with_their_blocks(spark):
    rng = np.random.default_rng(10)
    xy, z = np.vstack([rng.uniform(0, 90, (70, 2)), np.full((9, 2), 30.0)]), rng.normal(size=(79, 5))
    rows = [(f"p{i:02d}", i % 2, float(xy[i, 0]), float(xy[i, 1]), [float(v) for v in z[i]]) for i in range(79)]
    rows += [("twice", 0, 31.0, 30.0, [1.0] * 5), ("twice", 0, 31.0, 30.0, [1.0] * 5), ("gap", 0, 30.0, 31.0, [1.0, None, 1.0, 1.0, 1.0]), ("short", 0, 31.0, 31.0, [2.0]), ("small", 0, 31.0, 32.0, [3.0]), ("void", 0, 31.0, 32.5, None)]
    points = spark.createDataFrame(rows, "name string, zone int, x double, y double, z array<double>")
    ball = Structure((Variogram("spherical", 2.0, 40.0),), 0.25)
    pairs = G.point_covariance(points, ball, ["zone"], least=1.0, values="z", most=6)
    side = lambda c, a: points.select("zone", F.col("name").alias(c), F.col("z").alias(a), F.monotonically_increasing_id().alias(f"{a}i"))
    whole = G.point_covariance(points.dropDuplicates(["name"]), ball, ["zone"]).where("v >= 1")
    total = F.aggregate(F.zip_with("a", "b", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    want = whole.join(side("row", "a"), ["zone", "row"]).join(side("col", "b"), ["zone", "col"]).select("zone", "row", "col", F.round("v", 9).alias("v"), F.round(total, 9).alias("product"))
    got = pairs.select("zone", "row", "col", F.round("v", 9).alias("v"), F.round("product", 9).alias("product"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert [r["product"] for r in got.where("row = 'short' AND col = 'small'").collect()] == [6.0]
    assert got.where("row = 'gap' OR col = 'gap'").count() > 1 and got.where("row = 'twice' AND col = 'twice'").count() == 4
    assert ball.support > ball.reach(1.0) > 0 and abs(2.0 * (1 - 1.5 * ball.reach(1.0) / 40 + 0.5 * (ball.reach(1.0) / 40) ** 3) - 1.0) < 1e-6


def test_cells_of_a_parameter_ensemble_are_not_joined(spark, tmp_path):
    from brookcal.sources import text as SX

    files = {"a": ["p1 1.5 1.0 0.0", "p2 2.5 1.0 0.0", "p2 3.5 1.0 0.0", "other 9 1.0 0.0"], "b": ["p3 4.5 1.0 0.0"], "c": ["other 9 1.0 0.0"]}
    for real, lines in files.items():
        (tmp_path / f"bucket={real}").mkdir()
        (tmp_path / f"bucket={real}" / "x.par").write_text("\n".join(["single point", *lines]) + "\n")
    pars = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p3",), (None,)], "parnme string")
    t = SX.scan_parameter_ensemble(spark, str(tmp_path), pars, r"bucket=([^/]+)/")
    given = [("a", "p1", 1.5), ("a", "p2", 2.5), ("a", "p2", 3.5), ("b", "p3", 4.5)]
    lacking = [(r, n, None) for n in ("p1", "p2", "p3", None) for r in "abc" if not any(g[:2] == (r, n) for g in given)]
    assert sorted(map(tuple, t.collect()), key=str) == sorted(given + lacking, key=str)
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_tasks_of_names_and_entries_grow_with_the_lines(spark, tmp_path, monkeypatch):
    import checks
    from brookcal import session

    checks.load()
    from checks import pairs, series

    day = lambda i: datetime.datetime(1996, 1, 1) + datetime.timedelta(days=i % 9)
    lines = [(i, i % 5, i % 3, 1, float(i), day(i)) for i in range(40)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"Brand#{i % 2}") for i in range(5)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    for module in (session, series):
        monkeypatch.setattr(module, "ROWS_PER_TASK", 5)
    entries, parsed = pairs.jacobian(spark, str(tmp_path)), series.parse(spark, str(tmp_path))
    assert entries.rdd.getNumPartitions() == 8 and parsed.rdd.getNumPartitions() == 32
    assert entries.count() == 6 and entries.agg(F.sum("v")).first()[0] == sum(range(40)) / 100
    # the days of each of three suppliers, and its month, its year and its month of any year
    assert parsed.count() == len({(i % 3, i % 9) for i in range(40)}) + 9


def test_quarters_of_a_gauge_are_formed_once(spark, capsys):
    from brookcal.operators import regime

    flow = spark.range(400).select(F.lit("g").alias("loc"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") % 17).cast("double").alias("discharge"))
    states = regime.limb_states(flow)
    capsys.readouterr()
    states.explain()
    assert "Window" not in capsys.readouterr().out
    assert states.count() == 400


def test_tiles_of_one_chunk_are_not_shuffled_again(spark, capsys):
    from brookcal.operators import pairs as X

    m = np.random.default_rng(11).integers(0, 3, (6, 9)).astype(float)
    rows = spark.createDataFrame([(f"r{i}", f"k{k}", float(m[k, i])) for i in range(9) for k in range(6) if m[k, i]], "row string, k string, v double")
    other = rows.select("k", F.col("row").alias("col"), "v")
    for inner, steps in ((6, 2), (2, 3)):
        one, two = X.gram_product(rows, tile=4, inner=inner), X.block_product(rows, other, tile=4, inner=inner)
        capsys.readouterr()
        one.explain()
        assert capsys.readouterr().out.count("FlatMapGroupsInPandas") == steps
        whole = {(f"r{i}", f"r{j}"): float(m[:, i] @ m[:, j]) for i in range(9) for j in range(9) if (m[:, i] * m[:, j]).any()}
        assert {(r["row"], r["col"]): r["v"] for r in two.collect()} == whole
        assert {(r["row"], r["col"]): r["v"] for r in one.collect()} == {k: v for k, v in whole.items() if k[0] <= k[1]}


def test_single_observations_are_picked_from_a_large_ensemble(spark, monkeypatch):
    from brookcal.operators import data_worth as W

    x = np.random.default_rng(12).normal(size=(14, 6)) @ np.random.default_rng(13).normal(size=(6, 6))
    ens = spark.createDataFrame([(f"{i}", f"o{j}", float(x[i, j])) for i in range(14) for j in range(6)], "real string, name string, value double")
    groups = spark.createDataFrame([(f"o{j}", f"o{j}") for j in range(4)], "group string, name string")
    noise = spark.createDataFrame([(f"o{j}", 0.5) for j in range(4)], "name string, var double")
    preds = spark.createDataFrame([("o4",), ("o5",)], "name string")
    # more realizations than one task solves for were an error
    monkeypatch.setattr(W, "IN_REALIZATION_SPACE", 9)
    monkeypatch.setattr(W, "MOST_REALIZATIONS", 9)
    c, left = np.cov(x.T), {}
    for j in range(4):
        left[f"o{j}"] = sum(c[p, p] - c[j, p] ** 2 / (c[j, j] + 0.5) for p in (4, 5))
    best = W.best_additions(ens, groups, noise, preds, 1).collect()[0]
    assert best["group"] == min(left, key=left.get) and np.isclose(best["variance"], left[best["group"]])


def test_tiles_of_all_pairs_are_not_broadcast(spark, capsys):
    xy = np.random.default_rng(14).uniform(0, 90, (30, 2))
    points = spark.createDataFrame([(f"p{i:02d}", float(x), float(y)) for i, (x, y) in enumerate(xy)], "name string, x double, y double").coalesce(1)
    pairs = G.point_covariance(points, Structure((Variogram("exponential", 1.0, 5.0),)), full=True)
    capsys.readouterr()
    pairs.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and pairs.count() == 465


def test_ranks_in_boxes_and_relative_weights(spark, monkeypatch):
    """Ranks by name in the box of each target, with names and targets that repeat; no pair is sorted or joined for them."""
    monkeypatch.setattr(G, "BOX_TARGETS", 5)
    rng = np.random.default_rng(21)
    a, b = rng.uniform(-30, 30, (50, 2)).round(), rng.uniform(-30, 30, (200, 2)).round()
    targets = [(f"t{i % 45}", i % 2, float(x), float(y)) for i, (x, y) in enumerate(a)] + [(None, 0, 0.0, 0.0)]
    points = [(None if i % 40 == 7 else f"p{i % 190:03d}", i % 2, float(x), float(y), None if i % 9 == 4 else 1.0 + i % 190) for i, (x, y) in enumerate(b)]
    t = spark.createDataFrame(targets, "target string, zone int, x double, y double")
    p = spark.createDataFrame(points, "name string, zone int, x double, y double, value double")
    valued = G.with_summand(p.drop("value"), p.select("name", "value"), log=True)
    near = G.within_box(t.select("target", "zone", F.col("x").alias("tx"), F.col("y").alias("ty")), valued, 8.0, ["zone"], order="name", values="_v")
    w = near.select("target", (F.lit(1.0) / F.col("rank")).alias("w"), "_v")
    got = sorted(((r["target"] or "", r["value"]) for r in G.apply_weights(w, None, t, log=True, fill=-7.0, relative=True).collect()))
    want = []
    for name, *_ in targets:
        mine = [n or "" for target, zone, x, y in targets if target == name and name for n, z, u, v, _ in points if z == zone and abs(u - x) < 8 and abs(v - y) < 8]
        terms = [(1 / (i + 1), [np.log10(q[4]) for q in points if n and q[0] == n and q[4] is not None]) for i, n in enumerate(sorted(mine))]
        found = sum(len(v) for _, v in terms)
        want.append((name or "", 10 ** (sum(u * sum(v) for u, v in terms) / sum(u for u, _ in terms)) if found else -7.0))
    assert [x for x, _ in got] == [x for x, _ in sorted(want)]
    np.testing.assert_allclose([x for _, x in got], [x for _, x in sorted(want)], rtol=1e-9)
    assert near.where("target = 't20'").count() == near.where("target = 't20'").agg(F.max("rank")).first()[0] > 0


def test_blocks_of_values_travel_by_groups(spark, monkeypatch):
    """Each pair is met once with its product, and blocks travel less often than they are compared."""
    monkeypatch.setattr(G, "GROUP_BLOCKS", 4)
    rng = np.random.default_rng(31)
    xy = np.vstack([rng.uniform(0, 90, (260, 2)), np.full((40, 2), 33.0)])
    z = rng.normal(size=(300, 5))
    rows = [(f"p{i:03d}", i % 2, float(xy[i, 0]), float(xy[i, 1]), [float(v) for v in z[i]]) for i in range(300)]
    points = spark.createDataFrame(rows, "name string, zone int, x double, y double, z array<double>")
    ball = Structure((Variogram("spherical", 2.0, 40.0),), 0.25)
    got = {(r["row"], r["col"]): r["product"] for r in G.point_covariance(points, ball, ["zone"], most=6, least=0.8, values="z").collect()}
    h = np.minimum(np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) / 40.0, 1.0)
    v = 2.0 * (1.0 - 1.5 * h + 0.5 * h**3)
    want = {(f"p{i:03d}", f"p{j:03d}"): z[i] @ z[j] for i in range(300) for j in range(i, 300) if i % 2 == j % 2 and v[i, j] >= 0.8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    pairs, _ = G._near_blocks(points, ["zone"], 20.0, 6, 40.0, 4)
    task = ["zone", "_g1", "_g2"]
    members = pairs.select(*task, F.explode(F.array("_l", "_r")).alias("b")).distinct()
    assert members.count() < 0.5 * 2 * pairs.count()
    assert members.groupBy(*task).count().agg(F.max("count")).first()[0] <= 40
