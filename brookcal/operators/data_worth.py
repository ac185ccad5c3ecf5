"""Data worth and group conflict from ensembles, in realization space.

The matrices of the usual formulas have one row per observation, which grows
without bound. Their duals have one row per realization: for deviations D
(realizations x observations, scaled by 1/sqrt(n-1)) and noise variance R,

    D (D'D + R)^-1 D' = I - (I + D R^-1 D')^-1

so only D R^-1 D' is needed. That Gram matrix is a blocked product over the
observations; one group then solves a system of the size of the ensemble,
which is fixed by the run and does not grow with the data. One task holds that
system, of ``MOST_REALIZATIONS`` at most, so an ensemble of more than
``IN_REALIZATION_SPACE`` is solved in observation space instead, by one row per
observation of the group:

    D (D'D + R)^-1 D' = S (I + S'S)^-1 S',  S = D R^-1/2

There the realizations are only summed over, in blocks, and multiplied by the
solution, chunk by chunk. A group of more than ``MOST_OBSERVATIONS`` is an error
there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookcal.functions.draws import uniform
from brookcal.operators.pairs import gram_product, gram_tiles
from brookcal.session import cut_lineage, one_row, spread

MOST_REALIZATIONS = 5000
#: Larger ensembles are solved in observation space.
IN_REALIZATION_SPACE = 5000
MOST_OBSERVATIONS = 5000
#: Realizations that one task multiplies by a solution in observation space.
CHUNK = 4096


def _solvable(n: Column, most: int, what: str = "realizations") -> Column:
    message = F.concat(n.cast("string"), F.lit(f" {what} are more than the {most} one task solves for"))
    return F.when(n > most, F.raise_error(message).cast("long")).otherwise(n)


def _chunk(reals: DataFrame) -> Column:
    """Number of chunks of about ``CHUNK`` realizations."""
    found = one_row(reals, F.approx_count_distinct("real"))["x0"]
    return F.greatest(F.ceil(found / F.lit(float(CHUNK))), F.lit(1)).cast("int")


def _square(tiles: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The full symmetric matrix of packed tiles."""
    names = np.unique(np.concatenate([*tiles["rows"], *tiles["cols"]]))
    m = np.zeros((len(names), len(names)))
    for rows, cols, v in zip(tiles["rows"], tiles["cols"], tiles["v"]):
        i, j = np.searchsorted(names, rows), np.searchsorted(names, cols)
        part = np.asarray(v).reshape(len(rows), len(cols))
        m[np.ix_(i, j)] = part
        m[np.ix_(j, i)] = part.T
    return names, m


def _apply_gain(key, gram: pd.DataFrame, pred: pd.DataFrame) -> pd.DataFrame:
    """(I - (I + K)^-1) d for every prediction column of one tile."""
    if not len(gram):
        raise ValueError(f"group {key[1]} has no values in the ensemble")
    if not len(pred):
        return pd.DataFrame({"run": [], "group": [], "real": [], "name": [], "md": []})
    reals, k = _square(gram)
    n = len(reals)
    at = {r: i for i, r in enumerate(reals)}
    cols, names = pd.factorize(pred["name"])
    d = np.zeros((n, len(names)))
    d[pred["real"].map(at).to_numpy(), cols] = pred["dev"].to_numpy()
    moved = d - np.linalg.solve(np.eye(n) + k, d)
    return pd.DataFrame({
        "run": key[0], "group": key[1], "real": np.repeat(reals, len(names)),
        "name": np.tile(np.asarray(names, dtype=object), n), "md": moved.ravel()})


def _scaled_deviations(ens: DataFrame) -> DataFrame:
    """Deviations over sqrt(n - 1) per run, with the prior mean of every name."""
    n = ens.groupBy("run").agg(F.count_distinct("real").alias("_n"))
    c = ens.groupBy("run", "name").agg(F.avg("value").alias("prior_mean"), F.var_samp("value").alias("prior_var"))
    return ens.join(c, ["run", "name"]).join(n, "run").withColumn(
        "dev", (F.col("value") - F.col("prior_mean")) / F.sqrt(F.col("_n") - 1.0))


def _weights(key, system: pd.DataFrame, cross: pd.DataFrame) -> pd.DataFrame:
    """(I + S'S)^-1 S'd for every prediction of one tile, per observation of one group."""
    if not len(system):
        raise ValueError(f"group {key[1]} has no values in the ensemble")
    if not len(cross):
        return pd.DataFrame({"run": [], "group": [], "k": [], "name": [], "w": [], "drop": []})
    seen = np.unique(system["row"])
    r, c = np.searchsorted(seen, system["row"]), np.searchsorted(seen, system["col"])
    a = np.zeros((len(seen), len(seen)))
    a[r, c] = system["v"]
    a[c, r] = system["v"]
    cols, names = pd.factorize(cross["name"])
    at = np.searchsorted(seen, cross["row"])
    b, root = np.zeros((len(seen), len(names))), np.ones(len(seen))
    b[at, cols] = cross["v"]
    root[at] = np.sqrt(cross["var"])
    w = np.linalg.solve(np.eye(len(seen)) + a, b)
    return pd.DataFrame({
        "run": key[0], "group": key[1], "k": np.repeat(seen, len(names)), "name": np.tile(np.asarray(names, dtype=object), len(seen)),
        "w": (w / root[:, None]).ravel(), "drop": (w * b).ravel()})


def _apply_weights(key, dev: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
    """Deviations of one chunk of realizations times the weights of one group and tile."""
    if not len(dev) or not len(weights):
        return pd.DataFrame({"run": [], "group": [], "real": [], "name": [], "md": []})
    ks = np.unique(weights["k"])
    rows, reals = pd.factorize(dev["real"])
    cols, names = pd.factorize(weights["name"])
    d, w = np.zeros((len(reals), len(ks))), np.zeros((len(ks), len(names)))
    np.add.at(d, (rows, np.searchsorted(ks, dev["name"])), dev["v"].to_numpy(dtype=float))
    w[np.searchsorted(ks, weights["k"]), cols] = weights["w"]
    return pd.DataFrame({
        "run": key[0], "group": key[1], "real": np.repeat(np.asarray(reals, dtype=object), len(names)),
        "name": np.tile(np.asarray(names, dtype=object), len(reals)), "md": (d @ w).ravel()})


def _observation_space(
    dev: DataFrame, weighed: DataFrame, predictions: DataFrame, tiles: Column, first_moment: bool
) -> tuple[DataFrame, DataFrame | None]:
    """``(run, group, name, _s)``, the variance each group takes from a prediction, and ``(run, group, real, name, _md)``.

    One Gram matrix of all names per run serves every group. A name with a missing value has no product, so what rests on it
    is NaN, as in realization space.
    """
    used = weighed.select("name").unionByName(predictions.select("name")).distinct()
    own = dev.join(used, "name", "left_semi")
    whole = own.groupBy("run", "name").agg(F.bool_and(F.col("dev").isNotNull() & ~F.isnan("dev")).alias("_whole"))
    full = own.join(whole.where("_whole"), ["run", "name"], "left_semi")
    gram = gram_product(full.select("run", F.col("name").alias("row"), F.col("real").alias("k"), F.col("dev").alias("v")), ["run"], dense=True)
    gram = cut_lineage(gram)
    both = gram.unionByName(gram.where(F.col("row") != F.col("col")).select("run", F.col("col").alias("row"), F.col("row").alias("col"), "v"))
    there = whole.select("run", "name").join(weighed.distinct(), "name")
    m = there.groupBy("run", "group").agg(_solvable(F.count(F.lit(1)), MOST_OBSERVATIONS, "observations of a group").alias("_m"))
    there = there.join(m.where("_m > 0").select("run", "group"), ["run", "group"])
    side = lambda c, v: there.select("run", "group", F.col("name").alias(c), F.col("var").alias(v))
    missing = F.lit(float("nan"))
    pairs = side("row", "_v1").join(side("col", "_v2"), ["run", "group"]).where(F.col("row") <= F.col("col"))
    system = pairs.join(gram, ["run", "row", "col"], "left").select(
        "run", "group", "row", "col", F.coalesce(F.col("v") / F.sqrt(F.col("_v1") * F.col("_v2")), missing).alias("v"),
        F.explode(F.sequence(F.lit(0), tiles - 1)).alias("_t"))
    wanted = whole.select("run", "name").join(predictions.select("name").distinct(), "name")
    # every listed group meets every prediction, also one that has no name in the run, which is an error
    every = weighed.agg(F.collect_set("group")).scalar()
    cross = wanted.withColumn("group", F.explode(every)).join(side("row", "var"), ["run", "group"], "left")
    cross = cross.join(both.withColumnRenamed("col", "name"), ["run", "row", "name"], "left").select(
        F.col("run").alias("run"), F.col("group").alias("group"), "row", "name", "var", F.coalesce(F.col("v") / F.sqrt("var"), missing).alias("v"),
        F.pmod(F.xxhash64("name"), tiles).cast("int").alias("_t"))
    key = ["run", "group", "_t"]
    weights = spread(system, *key).groupBy(*key).cogroup(spread(cross, *key).groupBy(*key)).applyInPandas(
        _weights, "run string, group string, k string, name string, w double, drop double")
    taken = weights.groupBy("run", "group", "name").agg(F.sum("drop").alias("_s"))
    if not first_moment:
        return taken, None
    chunks = _chunk(dev)
    rows = dev.join(there.select("run", "group", "name"), ["run", "name"]).select(
        "run", "group", "real", "name", F.col("dev").alias("v"), F.pmod(F.xxhash64("real"), chunks).cast("int").alias("_c"),
        F.explode(F.sequence(F.lit(0), tiles - 1)).alias("_t"))
    weights = cut_lineage(weights)
    taken = weights.groupBy("run", "group", "name").agg(F.sum("drop").alias("_s"))
    copies = weights.select("run", "group", "k", "name", "w", F.pmod(F.xxhash64("name"), tiles).cast("int").alias("_t"),
                            F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_c"))
    key = ["run", "group", "_t", "_c"]
    moved = spread(rows, *key).groupBy(*key).cogroup(spread(copies, *key).groupBy(*key)).applyInPandas(
        _apply_weights, "run string, group string, real string, name string, md double")
    return taken, moved.withColumnRenamed("md", "_md")


def _realization_space(dev: DataFrame, weighed: DataFrame, pred: DataFrame, tiles: Column) -> DataFrame:
    """``(run, group, real, name, _md)``: every prediction moved by every group."""
    rows = dev.where(_solvable(F.col("_n"), MOST_REALIZATIONS) > 0).join(weighed, "name").select(
        "run", "group", F.col("real").alias("row"), F.col("name").alias("k"), (F.col("dev") / F.sqrt("var")).alias("v"))
    gram = gram_tiles(rows, ["run", "group"], dense=True)
    targets = weighed.agg(F.collect_set("group")).scalar()
    cols = pred.select(
        "run", "real", "name", "dev", F.pmod(F.xxhash64("name"), tiles).cast("int").alias("_t"), F.explode(targets).alias("group"))
    tiled_gram = gram.withColumn("_t", F.explode(F.sequence(F.lit(0), tiles - 1)))
    tile_key = ["run", "group", "_t"]
    return (
        spread(tiled_gram, *tile_key).groupBy(*tile_key)
        .cogroup(spread(cols, *tile_key).groupBy(*tile_key))
        .applyInPandas(_apply_gain, "run string, group string, real string, name string, md double")
        .withColumnRenamed("md", "_md")
    )


def posterior_moments(
    ens: DataFrame,
    groups: DataFrame,
    noise: DataFrame,
    predictions: DataFrame,
    first_moment: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Posterior spread (and mean per realization) of predictions after adding each group.

    ``ens([run,] real, name, value)``, ``groups(group, name)``, ``noise(name, var)``,
    ``predictions(name)``. A group ``posterior`` with every listed name is added.
    Returns ``(run, group, name, prior_std, post_std, percent_reduction)`` and
    ``(run, group, real, name, mean)``. A listed name without noise variance and
    a group without any value in the ensemble are errors.
    """
    if "run" not in ens.columns:
        ens = ens.withColumn("run", F.lit("all"))
    everything = groups.select(F.lit("posterior").alias("group"), "name").distinct()
    members = groups.select("group", "name").unionByName(everything)
    # each of these is read many times below; their plans in every place would fill the driver's memory
    dev = cut_lineage(_scaled_deviations(ens).drop("value"))
    weighed = cut_lineage(members.join(noise.select("name", "var"), "name", "left"))
    predictions = cut_lineage(predictions.select("name"))
    unknown = F.raise_error(F.concat(F.lit("no noise variance for "), F.col("name"))).cast("double")
    weighed = weighed.withColumn("var", F.coalesce("var", unknown))
    pred = dev.join(predictions, "name", "left_semi")
    # every group meets every prediction: groups are listed by the caller, predictions come in tiles
    tiles = F.lit(max(1, -(-predictions.count() // 512)))
    least, most = dev.agg(F.min("_n"), F.max("_n")).collect()[0]
    drop, joined = [], []
    apart = least is not None and least <= IN_REALIZATION_SPACE < most
    if most is None or least <= IN_REALIZATION_SPACE:
        few = F.col("_n") <= IN_REALIZATION_SPACE
        in_reals = _realization_space(dev.where(few) if apart else dev, weighed, pred.where(few) if apart else pred, tiles)
        joined.append(in_reals.join(
            pred.select("run", "real", "name", "dev", "prior_mean", "prior_var", "_n"), ["run", "real", "name"]))
        drop.append(joined[0].groupBy("run", "group", "name").agg(
            F.max("prior_var").alias("_pv"), F.sum(F.col("dev") * F.col("_md")).alias("_s")))
    if most is not None and most > IN_REALIZATION_SPACE:
        many = F.col("_n") > IN_REALIZATION_SPACE
        taken, moved = _observation_space(dev.where(many) if apart else dev, weighed, predictions, tiles, first_moment)
        prior = pred.groupBy("run", "name").agg(F.max("prior_var").alias("_pv"))
        drop.append(taken.join(prior, ["run", "name"]).select("run", "group", "name", "_pv", "_s"))
        if first_moment:
            joined.append(moved.join(
                pred.select("run", "real", "name", "dev", "prior_mean", "prior_var", "_n"), ["run", "real", "name"]))
    drop, joined = reduce(DataFrame.unionByName, drop), reduce(DataFrame.unionByName, joined) if joined else None
    std = drop.select(
        "run", "group", "name", F.sqrt("_pv").alias("prior_std"),
        F.sqrt(F.greatest(F.col("_pv") - F.col("_s"), F.lit(0.0))).alias("post_std"),
    ).withColumn("percent_reduction", 100.0 * (1.0 - F.try_divide(F.col("post_std"), F.col("prior_std"))))
    means = joined.select(
        "run", "group", "real", "name", (F.col("prior_mean") + F.sqrt(F.col("_n") - 1.0) * F.col("_md")).alias("mean")
    ) if first_moment else None
    return std, means


def convergence(
    ens: DataFrame,
    groups: DataFrame,
    noise: DataFrame,
    predictions: DataFrame,
    sizes: Sequence[int],
    repeats: int,
    seed: int,
) -> DataFrame:
    """Mean posterior deviation per group and prediction over repeated subsets of each size."""
    ids = ens.select("real").distinct()
    runs = ids.select("real", F.explode(F.array(*[F.lit(int(s)) for s in sizes])).alias("size")).select(
        "real", "size", F.explode(F.sequence(F.lit(1), F.lit(int(repeats)))).alias("rep"))
    keyed = runs.withColumn("_u", uniform(seed, F.col("real"), F.col("size"), F.col("rep")))
    # ensemble ids only: at most sizes x repeats x ensemble size rows
    w = Window.partitionBy("size", "rep").orderBy("_u", "real")
    chosen = keyed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("size")).select(
        "real", F.concat_ws("/", F.col("size").cast("string"), F.col("rep").cast("string")).alias("run"))
    std, _ = posterior_moments(ens.join(chosen, "real"), groups, noise, predictions, first_moment=False)
    size = F.element_at(F.split("run", "/"), 1).cast("int")
    return std.groupBy(size.alias("size"), "group", "name").agg(
        F.avg("post_std").alias("post_std"), F.count(F.lit(1)).alias("repeats"))


def best_additions(
    ens: DataFrame, groups: DataFrame, noise: DataFrame, predictions: DataFrame, steps: int
) -> DataFrame:
    """Sequential pick: add the group that lowers the summed posterior variance most, then re-evaluate.

    ``steps`` is a handful of report lines; each step is one distributed
    evaluation whose single winning row decides the next.
    """
    spark = ens.sparkSession
    picked: list[str] = []
    out: list[tuple[int, str, float]] = []
    for step in range(1, int(steps) + 1):
        base = groups.where(F.col("group").isin(*picked)).select("name") if picked else None
        candidates = groups.where(~F.col("group").isin(*picked)) if picked else groups
        if base is not None:
            names = base.withColumn("group", F.explode(candidates.agg(F.collect_set("group")).scalar()))
            candidates = candidates.select("group", "name").unionByName(names.select("group", "name")).distinct()
        std, _ = posterior_moments(ens, candidates, noise, predictions, first_moment=False)
        best = (
            std.where(F.col("group") != "posterior").groupBy("group")
            .agg(F.sum(F.col("post_std") * F.col("post_std")).alias("v")).orderBy("v", "group").limit(1).collect()
        )
        if not best:
            break
        picked.append(best[0]["group"])
        out.append((step, best[0]["group"], float(best[0]["v"])))
    return spark.createDataFrame(out, "step int, group string, variance double")


def _loo_conflict(pdf: pd.DataFrame) -> pd.DataFrame:
    """Leave-one-out distances of the simulated rows and of the observed row."""
    names, g = _square(pdf)
    obs = int(np.nonzero(names == "\x00obs")[0][0])
    sim = np.delete(np.arange(len(names)), obs)
    nx = float(pdf["nx"].iloc[0])
    x = g[np.ix_(sim, sim)]
    b, zz = g[sim, obs], g[obs, obs]
    ne = len(sim)
    ns = ne - 1
    delta = 2.0 / (ns + 2.0)
    v = (np.trace(x) - x.sum() / ne) / (ne - 1) / nx
    c = delta * v * ((ns - 1) / (1 - delta))
    inv = np.linalg.inv(c * np.eye(ne) + x)
    row_sum, total = x.sum(axis=1), x.sum()
    dx, dz = np.empty(ne), np.empty(ne)
    for i in range(ne):
        # mean of the other rows, expressed through the Gram matrix
        x_mu = (row_sum - x[:, i]) / ns
        mu_mu = (total - 2.0 * row_sum[i] + x[i, i]) / ns**2
        xi_mu = (row_sum[i] - x[i, i]) / ns
        z_mu = (b.sum() - b[i]) / ns
        for out, xu, uu in ((dx, x[:, i] - x_mu, x[i, i] - 2 * xi_mu + mu_mu), (dz, b - x_mu, zz - 2 * z_mu + mu_mu)):
            y = np.array(xu)
            y[i] = 0.0
            # inverse of the matrix without row and column i
            w = inv @ y
            quad = y @ w - w[i] ** 2 / inv[i, i]
            out[i] = (uu - quad) / (delta * v)
    mu_x, mu_z = np.median(dx), np.median(dz)
    sigma = 1.4826 * np.median(np.abs(dx - mu_x))
    ordered = np.sort(dx)
    p = 1.0 - np.argmin(np.abs(ordered - mu_z)) / ne
    return pd.DataFrame({"obgnme": [pdf["group"].iloc[0]], "z_score": [(mu_z - mu_x) / sigma], "p_value": [p]})


def _conflict_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the distances of one group need of all its realizations: (cI + X'X)^-1, sums, the observed row and the scale."""
    names = np.unique(pdf["row"])
    r, c = np.searchsorted(names, pdf["row"]), np.searchsorted(names, pdf["col"])
    m = np.zeros((len(names), len(names)))
    m[r, c] = pdf["v"]
    m[c, r] = pdf["v"]
    on = pdf[pdf["row"] == pdf["col"]]
    at = np.searchsorted(names, on["row"])
    s, z = np.zeros(len(names)), np.zeros(len(names))
    s[at], z[at] = on["s"], on["obsval"]
    nx, ne = float(pdf["nx"].iloc[0]), int(pdf["ne"].iloc[0])
    ns = ne - 1
    delta = 2.0 / (ns + 2.0)
    v = (np.trace(m) - s @ s / ne) / (ne - 1) / nx
    c = delta * v * ((ns - 1) / (1 - delta))
    inverse = np.linalg.inv(c * np.eye(len(names)) + m)
    return pd.DataFrame({
        "group": [pdf["group"].iloc[0]], "names": [names], "inverse": [inverse.ravel()], "s": [s], "z": [z], "ne": [ne], "scale": [c / (delta * v)]})


def _chunk_conflict(key, dev: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """Leave-one-out distances of one chunk of realizations; leaving a row out is a rank-one change of the inverse."""
    if not len(dev) or not len(model):
        return pd.DataFrame({"group": [], "dx": [], "dz": []})
    one = model.iloc[0]
    names, ns = np.asarray(one["names"], dtype=object), one["ne"] - 1
    inverse = np.asarray(one["inverse"]).reshape(len(names), len(names))
    rows, reals = pd.factorize(dev["real"])
    x = np.zeros((len(reals), len(names)))
    np.add.at(x, (rows, np.searchsorted(names, dev["name"])), dev["value"].to_numpy(dtype=float))
    mu = (np.asarray(one["s"]) - x) / ns
    xb = x @ inverse
    left = 1.0 - (xb * x).sum(axis=1)
    far = {}
    for out, u in (("dx", x - mu), ("dz", np.asarray(one["z"]) - mu)):
        far[out] = one["scale"] * (((u @ inverse) * u).sum(axis=1) + (xb * u).sum(axis=1) ** 2 / left)
    return pd.DataFrame({"group": key[0], **far})


def _conflict_in_observation_space(sim: DataFrame, o: DataFrame, nx: DataFrame) -> DataFrame:
    """``group_conflict`` for any number of realizations: they are summed over, then measured in chunks.

    A missing value makes every distance of its group NaN, as in realization space.
    """
    sim = sim.withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    sums = sim.groupBy("group", "name").agg(F.sum("value").alias("s"))
    size = sim.groupBy("group").agg(F.count_distinct("real").alias("ne"))
    m = sums.groupBy("group").agg(_solvable(F.count(F.lit(1)), MOST_OBSERVATIONS, "observations of a group").alias("_m")).where("_m > 0")
    seen = o.groupBy("group", "name").agg(F.sum("obsval").alias("obsval"))
    whole = sim.join(sums.where(~F.isnan("s")), ["group", "name"], "left_semi")
    gram = gram_product(whole.select("group", F.col("name").alias("row"), F.col("real").alias("k"), F.col("value").alias("v")), ["group"], dense=True)
    side = lambda c: sums.select("group", F.col("name").alias(c))
    pairs = side("row").join(side("col"), "group").where(F.col("row") <= F.col("col")).join(gram, ["group", "row", "col"], "left")
    system = pairs.withColumn("v", F.coalesce("v", F.lit(float("nan")))).join(
        sums.join(seen, ["group", "name"]).withColumnRenamed("name", "row"), ["group", "row"]).join(nx, "group").join(size, "group").join(m, "group")
    model = spread(system, "group").groupBy("group").applyInPandas(
        _conflict_model, "group string, names array<string>, inverse array<double>, s array<double>, z array<double>, ne long, scale double")
    chunks = _chunk(sim)
    rows = sim.withColumn("_c", F.pmod(F.xxhash64("real"), chunks).cast("int"))
    copies = model.withColumn("group", F.col("group").alias("group")).withColumn("_c", F.explode(F.sequence(F.lit(0), chunks - 1)))
    key = ["group", "_c"]
    far = spread(rows, *key).groupBy(*key).cogroup(spread(copies, *key).groupBy(*key)).applyInPandas(
        _chunk_conflict, "group string, dx double, dz double")
    far = cut_lineage(far)
    middle = far.groupBy("group").agg(F.median("dx").alias("mx"), F.median("dz").alias("mz"), F.count(F.lit(1)).alias("ne"))
    at = far.join(middle, "group")
    # of two values equally near the lower comes first in the order
    near = at.groupBy("group").agg(
        F.median(F.abs(F.col("dx") - F.col("mx"))).alias("mad"), F.min(F.struct(F.abs(F.col("dx") - F.col("mz")).alias("off"), "dx"))["dx"].alias("near"))
    place = far.join(near.select("group", "near"), "group").groupBy("group").agg(F.count_if(F.col("dx") < F.col("near")).alias("place"))
    return middle.join(near, "group").join(place, "group").select(
        F.col("group").alias("obgnme"), ((F.col("mz") - F.col("mx")) / (1.4826 * F.col("mad"))).alias("z_score"),
        (1.0 - F.col("place") / F.col("ne")).alias("p_value"))


def group_conflict(ens: DataFrame, obs: DataFrame) -> DataFrame:
    """Per group: z-score and p-value of the observed row among leave-one-out distances."""
    o = obs.where(F.col("weight") > 0).select(F.col("obsnme").alias("name"), F.col("obgnme").alias("group"), "obsval")
    nx = o.groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("nx"))
    reals = ens.agg(F.count_distinct("real")).collect()[0][0]
    if reals > IN_REALIZATION_SPACE:
        return _conflict_in_observation_space(ens.join(o, "name").select("group", "real", "name", "value"), o, nx)
    nx = nx.where(_solvable(F.lit(reals), MOST_REALIZATIONS) > 0)
    sim = ens.join(o, "name").select("group", F.col("real").alias("row"), F.col("name").alias("k"), F.col("value").alias("v"))
    seen = o.select("group", F.lit("\x00obs").alias("row"), F.col("name").alias("k"), F.col("obsval").alias("v"))
    rows = sim.unionByName(seen)
    gram = gram_tiles(rows, ["group"], dense=True)
    return spread(gram.join(nx, "group"), "group").groupBy("group").applyInPandas(
        _loo_conflict, "obgnme string, z_score double, p_value double")
