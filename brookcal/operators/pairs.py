"""Pairwise quantities as blocked products of long matrices.

A self join on realizations would emit one row per (pair, realization). Here
both sides are cut into hash blocks of bounded size; each task multiplies two
dense tiles with NumPy and emits the product as one packed row, and the partial
tiles of the inner chunks are added. Block counts come from the data, so a
tile stays the same size however many names or realizations there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookcal.operators.ensembles import deviations
from brookcal.session import cut_lineage, one_row, spread

TILE = 512
INNER = 1024


def _tile_counts(df: DataFrame, sizes: dict[str, int]) -> Column:
    """Number of hash blocks per column that keep about ``size`` names in each, from one pass."""
    found = one_row(df, *[F.approx_count_distinct(c) for c in sizes])
    blocks = [F.greatest(F.ceil(found[f"x{i}"] / F.lit(float(n))), F.lit(1)).cast("int") for i, n in enumerate(sizes.values())]
    return F.array(*blocks)


def _in_one_chunk(rows: DataFrame, inner: int) -> bool:
    """Sparse tiles may be most of what is shuffled, so it is worth a count to know that they need no sum."""
    return rows.agg(F.approx_count_distinct("k")).collect()[0][0] <= inner


def _bucket(col: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(col), n).cast("int")


def _packer(keys: list[str], extra: list[str]):
    """Entries of one block and inner chunk as one row: sorted names and k, and the entries by place in that rectangle."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        k_codes, ks = pd.factorize(pdf["_k"], sort=True)
        a_codes, names = pd.factorize(pdf["_a"], sort=True)
        # entries given twice are added
        at, place = np.unique(a_codes.astype(np.int64) * len(ks) + k_codes, return_inverse=True)
        v = np.bincount(place, pdf["_v"].to_numpy(dtype=float), len(at))
        first = np.unique(a_codes, return_index=True)[1]
        same = {c: [pdf[c].iloc[0]] for c in [*keys, "_b", "_kc"]}
        own = {x: [pdf[x].to_numpy(dtype=float)[first]] for x in extra}
        return pd.DataFrame({**same, "names": [np.asarray(names, dtype=object)], "ks": [np.asarray(ks, dtype=object)], "at": [at], "v": [v], **own})

    return pack


def _packed(rows: DataFrame, keys: list[str], extra: Sequence[str] = ()) -> DataFrame:
    """Each entry of ``rows(keys, _a, _k, _v, _b, _kc)`` is shuffled once; what is copied to tiles later are packed rows.

    A packed row has up to about TILE names and INNER k and holds no string per entry.
    """
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["_b int", "_kc int", "names array<string>", "ks array<string>", "at array<long>", "v array<double>"] + [
        f"`{x}` array<double>" for x in extra])
    texts = rows.withColumn("_a", F.col("_a").cast("string")).withColumn("_k", F.col("_k").cast("string"))
    group = [*keys, "_b", "_kc"]
    return spread(texts, *group).groupBy(*group).applyInPandas(_packer(keys, list(extra)), schema)


def _unpack(row: pd.Series, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of a packed row, its values over ``ks``, and where it has some."""
    names, own, at = np.asarray(row["names"], dtype=object), np.asarray(row["ks"], dtype=object), np.asarray(row["at"])
    values, seen = np.zeros((len(names), len(ks))), np.zeros((len(names), len(ks)))
    r, c = at // len(own), np.searchsorted(ks, own)[at % len(own)]
    values[r, c], seen[r, c] = row["v"], 1.0
    return names, values, seen


def _multiplier(keys: list[str], dense: bool, extra: list[str]):
    columns = [*keys, "_bi", "_bj", "rows", "cols", "v", *[f"r_{x}" for x in extra], *[f"c_{x}" for x in extra]]

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        if len(pdf) == 1 and not one["_self"]:
            return pd.DataFrame(columns=columns)  # the other block has nothing in this chunk
        left, right = (one, one) if one["_self"] else (pdf[pdf["_left"]].iloc[0], pdf[~pdf["_left"].astype(bool)].iloc[0])
        ks = np.unique(np.concatenate([np.asarray(p["ks"], dtype=object) for p in (left, right)]))
        rn, a, seen_a = _unpack(left, ks)
        cn, b, seen_b = (rn, a, seen_a) if one["_self"] else _unpack(right, ks)
        product = np.nan_to_num(a @ b.T, nan=np.nan)
        if not dense:
            product[(seen_a @ seen_b.T) == 0] = np.nan
        sides = {f"{side}_{x}": [part[x]] for side, part in (("r", left), ("c", right)) for x in extra}
        return pd.DataFrame({**{c: [one[c]] for c in [*keys, "_bi", "_bj"]}, "rows": [rn], "cols": [cn], "v": [product.ravel()], **sides})[columns]

    return multiply


class _Tile:
    """Sum of the partial products of one tile, over names that may differ from chunk to chunk."""

    def __init__(self, extra: list[str]):
        self.extra = extra
        self.names = [np.array([], dtype=object)] * 2
        self.value, self.seen = np.zeros((0, 0)), np.zeros((0, 0), dtype=bool)
        self.own = {(side, x): np.zeros(0) for side in (0, 1) for x in extra}

    def add(self, rows: np.ndarray, cols: np.ndarray, v: np.ndarray, own: dict) -> None:
        wider = [np.union1d(mine, new) for mine, new in zip(self.names, (rows, cols))]
        if tuple(map(len, wider)) != self.value.shape:
            kept = [np.searchsorted(w, mine) for w, mine in zip(wider, self.names)]
            value, seen = np.zeros(tuple(map(len, wider))), np.zeros(tuple(map(len, wider)), dtype=bool)
            value[np.ix_(*kept)], seen[np.ix_(*kept)] = self.value, self.seen
            for (side, x), old in self.own.items():
                self.own[side, x] = np.zeros(len(wider[side]))
                self.own[side, x][kept[side]] = old
            self.names, self.value, self.seen = wider, value, seen
        at = [np.searchsorted(mine, new) for mine, new in zip(self.names, (rows, cols))]
        part = np.asarray(v, dtype=float).reshape(len(rows), len(cols))
        self.value[np.ix_(*at)] += np.nan_to_num(part)
        self.seen[np.ix_(*at)] |= ~np.isnan(part)
        for (side, x), values in own.items():
            self.own[side, x][at[side]] = values


def _sum_tile(batches: Iterator[pd.DataFrame], keys: list[str], extra: list[str]) -> tuple[dict, _Tile]:
    same, tile = {}, _Tile(extra)
    for pdf in batches:
        same = same or {c: pdf[c].iloc[0] for c in [*keys, "_bi", "_bj"]}
        for _, r in pdf.iterrows():
            tile.add(r["rows"], r["cols"], r["v"], {(i, x): r[f"{side}_{x}"] for i, side in enumerate("rc") for x in extra})
    return same, tile


def _summer(keys: list[str]):
    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        same, tile = _sum_tile(batches, keys, [])
        tile.value[~tile.seen] = np.nan
        yield pd.DataFrame({**{c: [v] for c, v in same.items()}, "rows": [tile.names[0]], "cols": [tile.names[1]], "v": [tile.value.ravel()]})

    return total


def _picker(keys: list[str], extra: list[str], test):
    """The pairs of a tile, row before col, that pass ``test(values, row extras, col extras)``."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        same, tile = _sum_tile(batches, keys, extra)
        found, value = test(tile.value, *[{x: tile.own[side, x] for x in extra} for side in (0, 1)])
        r, c = np.nonzero(found & tile.seen)
        a, b = tile.names[0][r], tile.names[1][c]
        if same["_bi"] == same["_bj"]:
            r, c, a, b = (x[a < b] for x in (r, c, a, b))
        swap = a > b
        row, col = np.where(swap, b, a), np.where(swap, a, b)
        yield pd.DataFrame({**{k: [same[k]] * len(r) for k in keys}, "row": row, "col": col, "v": value[r, c]})

    return pick


def _partial_tiles(both: DataFrame, keys: list[str], types: dict[str, str], dense: bool, extra: Sequence[str] = ()) -> DataFrame:
    """One row per tile and inner chunk; tiles travel packed, so no name is repeated per pair in a shuffle."""
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [
        "_bi int", "_bj int", "rows array<string>", "cols array<string>", "v array<double>"] + [f"`{s}_{x}` array<double>" for s in "rc" for x in extra])
    tile_key = [*keys, "_bi", "_bj"]
    return spread(both, *tile_key, "_kc").groupBy(*tile_key, "_kc").applyInPandas(_multiplier(keys, dense, list(extra)), schema)


def _multiply_tiles(both: DataFrame, keys: list[str], types: dict[str, str], dense: bool, one_chunk: bool = False) -> DataFrame:
    """One row per tile: names of both sides and the flattened values; a missing value marks pairs that share no k.

    Chunks of the inner dimension are added as they arrive: a task holds the
    sum and one batch, however many chunks there are. The product of ``one_chunk`` is the tile, and is not shuffled again.
    """
    if one_chunk:
        return _partial_tiles(both, keys, types, dense)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["_bi int", "_bj int", "rows array<string>", "cols array<string>", "v array<double>"])
    tile_key = [*keys, "_bi", "_bj"]
    parts = _partial_tiles(both, keys, types, dense)
    return spread(parts, *tile_key).groupBy(*tile_key).applyInPandas(_summer(keys), schema)


def _entries(tiles: DataFrame, keys: list[str], symmetric: bool) -> DataFrame:
    width = F.size("cols")
    long = tiles.select(*keys, "_bi", "_bj", "rows", "cols", F.posexplode("v").alias("_p", "v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")).select(
        *keys, "_bi", "_bj", F.get("rows", F.floor(F.col("_p") / width).cast("int")).alias("row"),
        F.get("cols", F.col("_p") % width).alias("col"), "v")
    if not symmetric:
        return long.select(*keys, "row", "col", "v")
    return long.where((F.col("_bi") < F.col("_bj")) | (F.col("row") <= F.col("col"))).select(
        *keys, F.least("row", "col").alias("row"), F.greatest("row", "col").alias("col"), "v")


def _with_partners(packed: DataFrame, others: Column) -> DataFrame:
    """Packed rows copied to the tiles of their block with each of ``others``; a diagonal tile holds its block once."""
    b, o = F.col("_b"), F.col("_o")
    return packed.withColumn("_o", F.explode(others)).withColumn("_left", o >= b).withColumn("_self", o == b).withColumn(
        "_bi", F.least(b, o)).withColumn("_bj", F.greatest(b, o)).drop("_o", "_b")


def gram_tiles(
    rows: DataFrame, keys: Sequence[str] = (), dense: bool = False, tile: int = TILE, inner: int = INNER
) -> DataFrame:
    """Sum over k of v(a, k) x v(b, k), per key, as packed tiles with ``_bi`` <= ``_bj``.

    ``rows([keys,] row, k, v)`` is read once and each entry is shuffled once,
    to its block; packed blocks go to the tiles with the blocks after them
    (left) and before them (right).
    """
    keys = list(keys)
    n = _tile_counts(rows, {"row": tile, "k": inner})
    blocks, chunks = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    one_chunk = not dense and _in_one_chunk(rows, inner)
    chunks = F.lit(1) if one_chunk else chunks
    entries = rows.select(
        *keys, F.col("row").alias("_a"), F.col("k").alias("_k"), F.col("v").cast("double").alias("_v"),
        _bucket("row", blocks).alias("_b"), _bucket("k", chunks).alias("_kc"))
    both = _with_partners(_packed(entries, keys), F.sequence(F.lit(0), blocks - 1))
    return _multiply_tiles(both, keys, dict(rows.dtypes), dense, one_chunk)


def gram_product(
    rows: DataFrame, keys: Sequence[str] = (), dense: bool = False, tile: int = TILE, inner: int = INNER
) -> DataFrame:
    """The Gram matrix of ``gram_tiles`` as (row, col, v) with row <= col."""
    return _entries(gram_tiles(rows, keys, dense, tile, inner), list(keys), True)


def reaching_tiles(rows: DataFrame, least: float | None, extra: Sequence[str] = (), tile: int = TILE, inner: int = INNER) -> DataFrame:
    """Packed blocks next to the blocks with which a product of ``least`` or more in magnitude is possible.

    Blocks hold names of similar length, so by Cauchy-Schwarz the longest of two blocks bound all of their products; the
    other tiles are never formed. Without ``least`` all are.
    """
    # names of equal length are told apart by a hash, so that no block takes them all
    jitter = F.lit(1.0) + F.pmod(F.xxhash64("row"), F.lit(1 << 20)) * F.lit(1e-15)
    norms = cut_lineage(rows.groupBy("row").agg((F.sqrt(F.sum(F.col("v") * F.col("v"))) * jitter).alias("_norm")))
    names = norms.count()
    blocks = max(1, -(-names // tile))
    shares = [i / blocks for i in range(1, blocks)]
    # the driver holds two numbers a block
    cuts = norms.agg(F.percentile_approx("_norm", shares, 100_000)).collect()[0][0] if shares and names else []
    placed = norms.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, cuts or [])).cast("array<double>"), lambda c: c < F.col("_norm"))).cast("int"))
    tops = sorted((r["_b"], r["m"]) for r in placed.groupBy("_b").agg(F.max("_norm").alias("m")).collect())
    chunks = F.get(_tile_counts(rows, {"k": inner}), F.lit(0))
    entries = rows.join(placed, "row").select(
        F.col("row").alias("_a"), F.col("k").alias("_k"), F.col("v").cast("double").alias("_v"), "_b", _bucket("k", chunks).alias("_kc"), *extra)
    # tops rise with the block, so the partners of a block are all from a first one on
    partners = [(b, [o for o, n in tops if least is None or m * n * (1.0 + 1e-9) >= least][:1], tops[-1][0]) for b, m in tops]
    partners = rows.sparkSession.createDataFrame(partners, "_b int, first array<int>, last int")
    reach = _packed(entries, [], extra).join(partners, "_b").where(F.size("first") > 0)
    return _with_partners(reach, F.sequence(F.get("first", F.lit(0)), F.col("last"))).drop("first", "last")


def gram_hits(
    rows: DataFrame, test, least: float | None = None, extra: Sequence[str] = (), dense: bool = True, tile: int = TILE, inner: int = INNER
) -> DataFrame:
    """Pairs (row < col) of the Gram matrix of ``rows(row, k, v)`` that pass a test, found inside the tile tasks.

    ``test(values, row_extras, col_extras)`` gets a tile and, by name, the ``extra`` columns of its rows and columns (one value a
    name), and returns which pairs to keep and the value to report. ``least`` is a magnitude without which no pair passes.
    """
    both = reaching_tiles(rows, least, extra, tile, inner)
    parts = _partial_tiles(both, [], {}, dense, extra)
    return spread(parts, "_bi", "_bj").groupBy("_bi", "_bj").applyInPandas(_picker([], list(extra), test), "row string, col string, v double")


def block_product(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = (),
    dense: bool = False,
    tile: int = TILE,
    inner: int = INNER,
) -> DataFrame:
    """Sum over k of left(row, k) x right(k, col), per key.

    Without ``dense`` only pairs that share at least one k appear, as in a join.
    """
    keys = list(keys)
    n = _tile_counts(left, {"row": tile, "k": inner})
    rb, kc = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    one_chunk = not dense and _in_one_chunk(left, inner)
    kc = F.lit(1) if one_chunk else kc
    cb = F.get(_tile_counts(right, {"col": tile}), F.lit(0))
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))

    def side(df: DataFrame, name: str, blocks: Column) -> DataFrame:
        return _packed(df.select(
            *keys, F.col(name).alias("_a"), F.col("k").alias("_k"), F.col("v").cast("double").alias("_v"),
            _bucket(name, blocks).alias("_b"), _bucket("k", kc).alias("_kc")), keys)

    lhs = side(left, "row", rb).withColumn("_left", F.lit(True)).withColumn("_bj", every(cb)).withColumnRenamed("_b", "_bi")
    rhs = side(right, "col", cb).withColumn("_left", F.lit(False)).withColumn("_bi", every(rb)).withColumnRenamed("_b", "_bj")
    both = lhs.unionByName(rhs).withColumn("_self", F.lit(False))
    return _entries(_multiply_tiles(both, keys, dict(left.dtypes), dense, one_chunk), keys, False)


# covariance ---------------------------------------------------------------


def covariance(
    ens: DataFrame,
    keys: Sequence[str] = (),
    localizer: DataFrame | None = None,
    center_on: str | None = None,
) -> DataFrame:
    """Upper triangle (row <= col) of the empirical covariance, over n - 1.

    ``keys`` restricts pairs to one group, e.g. the observation group carried
    by ``ens``. ``localizer(row, col, v)`` multiplies and keeps its own entries.
    """
    if keys:
        center = ens.groupBy("name").agg(F.avg("value").alias("_c")) if center_on is None else ens.where(
            F.col("real") == center_on).select("name", F.col("value").alias("_c"))
        dev = ens.join(center, "name").withColumn("value", F.col("value") - F.col("_c"))
    else:
        dev = deviations(ens, center_on)
    n = one_row(ens, F.count_distinct("real"))["x0"]
    left = dev.select(*keys, F.col("name").alias("row"), F.col("real").alias("k"), F.col("value").alias("v"))
    cov = gram_product(left, keys, dense=True)
    cov = cov.withColumn("v", F.col("v") / (n - 1))
    if localizer is not None:
        loc = localizer.select(
            F.least("row", "col").alias("row"), F.greatest("row", "col").alias("col"), F.col("v").alias("_f")).distinct()
        cov = cov.join(loc, ["row", "col"]).withColumn("v", F.col("v") * F.col("_f")).drop("_f")
    return cov


def pearson(cov: DataFrame) -> DataFrame:
    """c / (s1 s2); the diagonal of the same table supplies the deviations."""
    diag = cov.where(F.col("row") == F.col("col")).select(F.col("row").alias("name"), F.sqrt("v").alias("_s"))
    return (
        cov.join(diag.select(F.col("name").alias("row"), F.col("_s").alias("_s1")), "row")
        .join(diag.select(F.col("name").alias("col"), F.col("_s").alias("_s2")), "col")
        .select("row", "col", F.try_divide(F.col("v"), F.col("_s1") * F.col("_s2")).alias("v"))
    )


def correlated_pairs(ens: DataFrame, least: float) -> DataFrame:
    """``(row, col, v)`` of names, row < col, whose correlation over the realizations is ``least`` or more; a constant has none.

    Correlations are tested in the tile that forms them, so only hits leave a task.
    """
    dev = deviations(ens)
    norm = dev.groupBy("name").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n")).where(F.col("_n") > 0)
    unit = dev.join(norm, "name").select(F.col("name").alias("row"), F.col("real").alias("k"), (F.col("value") / F.col("_n")).alias("v"))
    return gram_hits(unit, lambda v, a, b: (v >= least, v))


def tie_equations(pairs: DataFrame, pars: DataFrame) -> DataFrame:
    """Equation rows tying the adjustable ones among ``pairs(row, col, v)``; the correlation is the weight."""
    p = pars.where(~F.col("partrans").isin("tied", "fixed")).select(
        "parnme", F.when(F.col("partrans") == "log", F.format_string("log(%s)", "parnme")).otherwise(F.col("parnme")).alias("_t"))
    return (
        pairs.join(p.select(F.col("parnme").alias("row"), F.col("_t").alias("_a")), "row")
        .join(p.select(F.col("parnme").alias("col"), F.col("_t").alias("_b")), "col")
        .select(
            F.concat_ws("_", F.lit("pcc"), "row", "col").alias("pilbl"),
            F.concat(F.lit("1.0 * "), "_a", F.lit(" - 1.0 * "), "_b", F.lit(" = 0.0")).alias("equation"),
            F.col("v").alias("weight"), F.lit("regul_cc").alias("obgnme"))
    )


def correlation_equations(cov: DataFrame, pars: DataFrame, drop_tol: float = 1e-3) -> DataFrame:
    """Equation rows tying adjustable pairs whose signed correlation reaches the tolerance.

    From an ensemble, ``tie_equations(correlated_pairs(...))`` gives them without a table of all pairs.
    """
    return tie_equations(pearson(cov).where((F.col("row") < F.col("col")) & (F.col("v") >= drop_tol)), pars)


def _conflict(size: int, critical: float):
    def test(v: np.ndarray, a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
        c, r1, r2, v1, v2 = v / (size - 1), a["off"][:, None], b["off"][None, :], a["var"][:, None], b["var"][None, :]
        det = v1 * v2 - c * c
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = (r1 * r1 * v2 + r2 * r2 * v1 - 2.0 * r1 * r2 * c) / det
        return (det != 0) & (distance > critical), distance

    return test


def pair_conflict(ens: DataFrame, obs: DataFrame, critical: float = 9.2) -> DataFrame:
    """Pairs of non-zero observations whose 2-D distance r' C^-1 r exceeds the critical value; tested inside the tiles."""
    o = obs.where(F.col("weight") > 0).select(F.col("obsnme").alias("name"), "obsval")
    sim = ens.join(o.select("name"), "name", "left_semi")
    facts = sim.groupBy("name").agg(F.avg("value").alias("_m"), F.var_samp("value").alias("var")).join(o, "name").select(
        "name", (F.col("_m") - F.col("obsval")).alias("off"), "var")
    size = sim.agg(F.count_distinct("real")).collect()[0][0]
    rows = deviations(sim).join(facts, "name").select(F.col("name").alias("row"), F.col("real").alias("k"), F.col("value").alias("v"), "off", "var")
    hits = gram_hits(rows, _conflict(size, critical), extra=("off", "var"))
    return hits.select(F.col("row").alias("obsnme_1"), F.col("col").alias("obsnme_2"), F.col("v").alias("sq_distance"))


# Jacobian tables ``(obs, par, v)`` -------------------------------------------


def composite_parameter_sensitivity(jac: DataFrame, obs: DataFrame, pars: DataFrame) -> DataFrame:
    """sqrt(sum((w j)^2)) x |transformed value| / nnz^2 and the unscaled / nnz form per parameter."""
    from brookcal.operators.parameters import scaled_log

    nnz = one_row(obs, F.count_if(F.col("weight") > 0))["x0"]
    wj = jac.join(obs.select(F.col("obsnme").alias("obs"), "weight"), "obs").withColumn("_q", F.col("v") * F.col("weight"))
    p = pars.select(F.col("parnme").alias("par"), scaled_log(F.col("parval1")).alias("_x"))
    css = wj.groupBy("par").agg(F.sqrt(F.sum(F.col("_q") * F.col("_q"))).alias("_s")).join(p, "par")
    return css.select(
        "par", (F.col("_s") / nnz).alias("unscaled_css"), (F.col("_s") * F.col("_x") / (nnz * nnz)).alias("css"))


def composite_observation_sensitivity(jac: DataFrame, obs: DataFrame) -> DataFrame:
    """Norm of each weighted Jacobian row / (npar - 1)."""
    npar = one_row(jac, F.count_distinct("par"))["x0"]
    w = obs.select(F.col("obsnme").alias("obs"), "weight")
    q = jac.join(w, "obs").withColumn("_q", F.col("v") * F.col("weight"))
    return q.groupBy("obs").agg((F.sqrt(F.sum(F.col("_q") * F.col("_q"))) / (npar - 1)).alias("cso"))


def observation_competition(jac: DataFrame, obs: DataFrame, least: float | None = None) -> DataFrame:
    """w1 w2 sum_par(j1 j2) of non-zero observations, each pair once.

    With ``least``, only pairs (row < col) whose value has that magnitude; tiles that cannot hold one are not formed. Without it every
    pair that shares a parameter is a row, and the diagonal is 0.
    """
    w = obs.where(F.col("weight") > 0).select(F.col("obsnme").alias("obs"), "weight")
    q = jac.join(w, "obs").select(F.col("obs").alias("row"), F.col("par").alias("k"), (F.col("v") * F.col("weight")).alias("v"))
    if least is not None:
        return gram_hits(q, lambda v, a, b: (np.abs(v) >= least, v), least, dense=False)
    pairs = gram_product(q)
    return pairs.withColumn("v", F.when(F.col("row") == F.col("col"), F.lit(0.0)).otherwise(F.col("v")))


# coordinate-matrix algebra ``(row, col, v)`` -----------------------------------


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product; entries are aligned by name, never by position."""
    return block_product(
        a.select("row", F.col("col").alias("k"), "v"), b.select(F.col("row").alias("k"), "col", "v"))


def add(a: DataFrame, b: DataFrame, sign: float = 1.0) -> DataFrame:
    """Sum (or difference) over the union of the entries; one aggregate, no join."""
    both = a.select("row", "col", "v").unionByName(b.select("row", "col", (F.col("v") * sign).alias("v")))
    return both.groupBy("row", "col").agg(F.sum("v").alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "_w"), ["row", "col"]).select("row", "col", (F.col("v") * F.col("_w")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")


def select_entries(a: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    if rows is not None:
        a = a.join(rows.select(F.col("name").alias("row")), "row", "left_semi")
    if cols is not None:
        a = a.join(cols.select(F.col("name").alias("col")), "col", "left_semi")
    return a


def drop_entries(a: DataFrame, names: DataFrame, axis: str = "row") -> DataFrame:
    return a.join(names.select(F.col("name").alias(axis)), axis, "left_anti")


def extract(a: DataFrame, rows: DataFrame, cols: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The selected part and what is left after dropping those rows (and columns)."""
    taken = select_entries(a, rows, cols)
    left = drop_entries(a, rows, "row")
    return taken, drop_entries(left, cols, "col") if cols is not None else left


def extend(a: DataFrame, b: DataFrame) -> DataFrame:
    """Block diagonal of two matrices without common names; a shared name is an error."""
    both = a.select("row", "col", "v", F.lit(1).alias("_s")).unionByName(b.select("row", "col", "v", F.lit(2).alias("_s")))
    shared = both.groupBy("row").agg(F.min("_s").alias("_a"), F.max("_s").alias("_b")).where("_a <> _b")
    n = one_row(shared, F.count(F.lit(1)))["x0"]
    return both.select(
        "row", "col", F.when(n > 0, F.raise_error(F.lit("matrices share row names")).cast("double")).otherwise(F.col("v")).alias("v"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where(F.col("row") == F.col("col")).select(F.col("row").alias("name"), "v")


def replace_entries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of ``b`` take the place of those of ``a`` with the same names."""
    return a.join(b.withColumnRenamed("v", "_w"), ["row", "col"], "left").select(
        "row", "col", F.coalesce("_w", "v").alias("v"))


def to_dense(a: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Dense view of a small matrix with listed columns; absent entries are 0."""
    return a.groupBy("row").pivot("col", list(cols)).agg(F.first("v")).na.fill(0.0)


def from_dense(wide: DataFrame, row: str = "row") -> DataFrame:
    """Non-zero entries of a dense frame."""
    return wide.unpivot([row], [c for c in wide.columns if c != row], "col", "v").where("v <> 0").select(
        F.col(row).alias("row"), "col", F.col("v").cast("double").alias("v"))
