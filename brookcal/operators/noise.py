"""Observation noise that is correlated in time, for series of any length.

Noise whose correlation decays exponentially is a Markov chain: given the value before, a value does not depend on earlier ones. So
a draw is x(i) = r x(i-1) + sqrt(1 - r^2) z(i) along the sorted times of a series, an affine map per step, and maps can be chained
in any grouping. Rows are range-sorted by series and time; each chunk folds its last series to one map per realization, the maps of
chunks that share a series are chained, and the chunks are replayed from their true starts. No covariance is formed or factored.
A sum of exponentials is a sum of independent chains, a nugget adds independent values.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookcal.functions.draws import normals_of
from brookcal.functions.inequality import is_greater_than, is_less_than
from brookcal.functions.variograms import Structure
from brookcal.operators.sampling import observation_variance
from brookcal.session import cut_lineage, one_row, spread

#: Draws of one chunk, about.
CHUNK_DRAWS = 2_000_000
_DOUBLES = pa.list_(pa.float64())
_FOLDED = pa.schema([
    ("chunk", pa.int32()), ("first", pa.string()), ("first_t", pa.float64()), ("last", pa.string()), ("kind", pa.string()), ("last_t", pa.float64()),
    ("z", _DOUBLES), ("factor", _DOUBLES), ("x", _DOUBLES),
])
_FOLDED_SQL = "chunk int, first string, first_t double, last string, kind string, last_t double, z array<double>, factor array<double>, x array<double>"
_STATE = pa.schema([("chunk", pa.int32()), ("series", pa.string()), ("kind", pa.string()), ("t", pa.float64()), ("state", _DOUBLES)])
_STATE_SQL = "chunk int, series string, kind string, t double, state array<double>"
_NOISE_SQL = "name string, noise array<double>, mean double, std double, lower double, upper double, kept boolean"


class _Chain:
    """The chains of one series at one time: a row of ``x`` for each chain, a column for each realization."""

    def __init__(self, reach: np.ndarray, t: float, x: np.ndarray):
        self.reach, self.t, self.x, self.factor = reach, t, x, np.ones(len(reach))

    def step(self, t: float, z: np.ndarray) -> np.ndarray:
        r = np.exp((self.t - t) / self.reach)
        self.x = r[:, None] * self.x + np.sqrt(1.0 - r * r)[:, None] * z
        self.factor, self.t = self.factor * r, t
        return self.x


def _matrices(batch: pa.RecordBatch, names: list[str], n: int) -> list[np.ndarray]:
    """Normals of the rows that have some; a state that was carried in has none."""
    return [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in names]


def _fold(reaches: dict[str, np.ndarray], normals: list[str], n: int):
    """For each chunk, its last series as a map from its first value here to its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = chain = z1 = None
        for batch in batches:
            z_all = _matrices(batch, normals, n)
            for i, (chunk, series, kind, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk", "series", "kind", "t")))):
                reach = reaches[kind]
                z = np.stack([m[i] for m in z_all[: len(reach)]])
                first = first or (chunk, series, t)
                if last != (series, kind):
                    last, z1 = (series, kind), z
                    chain = _Chain(reach, t, np.zeros_like(z))
                else:
                    chain.step(t, z)
        if first is not None:
            row = (*first, *last, chain.t, z1.ravel().tolist(), chain.factor.tolist(), chain.x.ravel().tolist())
            yield pa.RecordBatch.from_pylist([dict(zip(_FOLDED.names, row))], schema=_FOLDED)

    return run


def _link(reaches: dict[str, np.ndarray], n: int):
    """The state with which each chunk starts, where the chunk before it ends in the same series. Reads chunks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = series = None
        for batch in batches:
            for r in batch.to_pylist():
                reach = reaches[r["kind"]]
                z, x = (np.array(r[c]).reshape(len(reach), n) for c in ("z", "x"))
                if series == r["first"]:
                    yield pa.RecordBatch.from_pylist(
                        [{"chunk": r["chunk"], "series": series, "kind": kind, "t": chain.t, "state": chain.x.ravel().tolist()}], schema=_STATE)
                # a series that fills the chunk goes on from the state before; another one begins here
                start = chain.step(r["first_t"], z) if series == r["first"] == r["last"] else z
                chain, series, kind = _Chain(reach, r["last_t"], np.array(r["factor"])[:, None] * start + x), r["last"], r["kind"]

    return run


def _replay(structures: dict[str, tuple], normals: list[str], n: int):
    """Noise of every row, in units of its standard deviation; a chunk's carried state comes before its rows."""
    reaches = {k: reach for k, (reach, _, _) in structures.items()}
    passed = ["mean", "std", "lower", "upper", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = where = None
        for batch in batches:
            z_all, at, noise, rows = _matrices(batch, normals, n), 0, [], []
            cols = [batch.column(c).to_pylist() for c in ("chunk", "series", "kind", "t", "state")]
            for i, (chunk, series, kind, t, state) in enumerate(zip(*cols)):
                reach, shares, nugget = structures[kind]
                if state is not None:
                    chain, where = _Chain(reach, t, np.array(state).reshape(len(reach), n)), (chunk, series)
                    continue
                z = np.stack([m[at] for m in z_all])
                at += 1
                if where == (chunk, series):
                    x = chain.step(t, z[: len(reach)])
                else:
                    x, where = z[: len(reach)], (chunk, series)
                    chain = _Chain(reaches[kind], t, x)
                noise.append(shares @ x + nugget * z[-1])
                rows.append(i)
            own = batch.take(pa.array(rows, pa.int64()))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * n, pa.int32()), pa.array(np.concatenate(noise) if noise else [], pa.float64()))
            yield pa.RecordBatch.from_arrays([own.column("name"), flat, *[own.column(c) for c in passed]], names=["name", "noise", *passed])

    return run


def noise_draw(
    obs: DataFrame, series: DataFrame, structures: Structure | Mapping[str, Structure], n: int, seed: int,
    enforce_bounds: bool = False, draw_one_sided: bool = False,
) -> DataFrame:
    """``(real, name, value)``: ``n`` realizations of observed values plus noise that is correlated in time.

    ``obs(obsnme, obgnme, obsval, weight[, standard_deviation, lower_bound, upper_bound])``; ``series(obsnme, series, t[, structure])``
    places observations in time, ``structure`` names one of ``structures``, whose variograms are exponential. The covariance of two
    observations of a series is std(i) std(j) (sum of c exp(-|t(i) - t(j)| / a), and the nugget where i = j), so a structure's
    sill should be 1. Other observations get independent noise. Observations without weight keep their value, and so
    do one-sided ones unless ``draw_one_sided``. ``enforce_bounds`` clips to the bounds that are given.

    A series entry without time, and one whose observation is unknown or without weight, is an error. Observations at one
    time differ by their nugget only. Values depend on the seed and the names, not on partitions.
    """
    structures = {"": structures} if isinstance(structures, Structure) else dict(structures)
    for label, s in structures.items():
        if any(v.kind != "exponential" for v in s.variograms):
            raise ValueError(f"structure {label or 'given'} is not exponential; noise in time needs a Markov chain")
    parts = {
        label: (np.array([v.a for v in s.variograms]), np.sqrt([v.contribution for v in s.variograms]), float(np.sqrt(s.nugget)))
        for label, s in structures.items()
    }
    normals = [f"z{k}" for k in range(max(len(s.variograms) for s in structures.values()) + 1)]
    drawn = [normals_of(seed, k, n).alias(c) for k, c in enumerate(normals)]

    def bound(c: str) -> Column:
        return F.col(c).cast("double") if c in obs.columns else F.lit(None).cast("double")

    one_sided = is_less_than(F.col("obgnme")) | is_greater_than(F.col("obgnme"))
    weighed = F.coalesce(F.col("weight") != 0, F.lit(False))
    base = obs.join(observation_variance(obs).withColumnRenamed("name", "obsnme"), "obsnme").select(
        F.col("obsnme").alias("name"), F.col("obsval").cast("double").alias("mean"), F.sqrt("var").alias("std"),
        bound("lower_bound").alias("lower"), bound("upper_bound").alias("upper"), weighed.alias("weighed"),
        (~weighed | (one_sided & F.lit(not draw_one_sided))).alias("kept"),
    )
    kind = F.col("structure") if "structure" in series.columns else F.lit(next(iter(structures)))
    named = series.select(F.col("obsnme").alias("name"), F.col("series").cast("string").alias("series"), kind.alias("kind"), F.col("t").cast("double").alias("t"))
    lost = one_row(named.join(base.where("weighed"), "name", "left_anti"), F.count(F.lit(1)))["x0"]
    wrong = (
        F.when(lost > 0, F.concat(lost.cast("string"), F.lit(" series entries have no observation with weight")))
        .when(F.col("t").isNull() | F.isnan("t"), F.concat(F.lit("no time for "), F.col("name")))
        .when(~F.col("kind").isin(*structures), F.concat(F.lit("unknown structure "), F.col("kind")))
    )
    checked = named.withColumn("t", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).otherwise(F.col("t")))
    placed = base.join(checked, "name")
    order = ("series", "kind", "t", "name")
    # a row is small but its draws are not: the number of chunks is set by the draws, or adaptive execution would merge them all
    count = max(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-series.count() * n // CHUNK_DRAWS))
    chunks = cut_lineage(placed.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("chunk", F.spark_partition_id()))
    reaches = {k: p[0] for k, p in parts.items()}
    # one row a chunk meets in one task
    folded = chunks.select("chunk", "series", "kind", "t", "name", *drawn).mapInArrow(_fold(reaches, normals, n), _FOLDED_SQL)
    states = folded.repartition(1).sortWithinPartitions("chunk").mapInArrow(_link(reaches, n), _STATE_SQL)
    columns = ["chunk", "series", "kind", "t", "name", "mean", "std", "lower", "upper", "kept"]
    rows = chunks.select(*columns).unionByName(states, allowMissingColumns=True)
    # a state stands before the rows of its chunk
    rows = rows.repartition(count, "chunk").sortWithinPartitions("chunk", F.col("state").isNull(), *order)
    z = [F.when(F.col("state").isNull(), d).alias(c) for d, c in zip(drawn, normals)]
    chained = rows.select(*columns, "state", *z).mapInArrow(_replay(parts, normals, n), _NOISE_SQL)
    alone = spread(base.join(named, "name", "left_anti"), "name").select("name", normals_of(seed, 0, n).alias("noise"), "mean", "std", "lower", "upper", "kept")
    # the outer form: an inner one adds a filter on the size, for which the draws would be made at the scan and once more here
    long = chained.unionByName(alone).select("*", F.posexplode_outer("noise").alias("i", "z"))
    value = F.col("mean") + F.col("std") * F.col("z")
    if enforce_bounds:
        # greatest and least skip bounds that are not given
        value = F.greatest(F.least(value, F.col("upper")), F.col("lower"))
    return long.select(F.col("i").cast("string").alias("real"), "name", F.when(F.col("kept"), F.col("mean")).otherwise(value).alias("value"))
