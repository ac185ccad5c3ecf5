"""Noise in time: covariance of draws, long series, bounds, errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookcal.functions.variograms import Structure, Variogram
from brookcal.operators.noise import noise_draw

NESTED = Structure((Variogram("exponential", 0.6, 3.0), Variogram("exponential", 0.3, 20.0)), 0.1)


def covariance(s, t):
    h = np.abs(t[:, None] - t[None, :])
    return sum(v.contribution * np.exp(-h / v.a) for v in s.variograms) + s.nugget * np.eye(len(t))


def wide(draws):
    return draws.toPandas().pivot(index="real", columns="name", values="value")


def test_covariance_of_draws(spark):
    rng = np.random.default_rng(5)
    t = {"g": np.sort(rng.uniform(0, 40, 25)), "h": np.array([1.0, 1.0, 4.0])}
    single = Structure((Variogram("exponential", 1.0, 5.0),))
    rows = [(f"{g}{i:02d}", g, float(10 * i), 1.0 + i % 3) for g, x in t.items() for i in range(len(x))] + [("alone", "x", 3.0, 0.5), ("off", "x", 4.0, 0.0)]
    obs = spark.createDataFrame([(n, g, v, 1.0 / s if s else 0.0) for n, g, v, s in rows], "obsnme string, obgnme string, obsval double, weight double")
    series = spark.createDataFrame(
        [(f"{g}{i:02d}", f"s{g}", float(x), "nested" if g == "g" else "single") for g, xs in t.items() for i, x in enumerate(xs)],
        "obsnme string, series string, t double, structure string").repartition(3)
    n = 8_000
    x = wide(noise_draw(obs, series, {"nested": NESTED, "single": single}, n, 11))
    assert x.shape == (n, 30) and (x["off"] == 4.0).all()
    for g, s in (("g", NESTED), ("h", single)):
        own = x[[f"{g}{i:02d}" for i in range(len(t[g]))]].to_numpy()
        std = 1.0 + np.arange(len(t[g])) % 3
        want = covariance(s, t[g])
        got = np.cov(own.T) / np.outer(std, std)
        assert np.abs(got - want).max() < 6 * np.sqrt(2 / n)
        assert np.abs((own.mean(axis=0) - 10 * np.arange(len(t[g]))) / std).max() < 6 / np.sqrt(n)
    assert abs(x["alone"].std() - 0.5) < 6 * 0.5 / np.sqrt(2 * n)
    assert abs(np.corrcoef(x["alone"], x["g00"])[0, 1]) < 6 / np.sqrt(n)
    # without a nugget, equal times have equal noise in units of the deviation
    assert np.allclose(x["h00"] - 0.0, (x["h01"] - 10.0) / 2)


def test_a_long_series_does_not_depend_on_chunks(spark):
    """A group of 100,000 names and many short ones, in many chunks and in one."""
    size = 100_000
    obs = spark.range(size + 300).select(
        F.format_string("o%06d", "id").alias("obsnme"), F.lit("g").alias("obgnme"), F.lit(0.0).alias("obsval"), F.lit(1.0).alias("weight"))
    number = F.substring("obsnme", 2, 6).cast("int")
    series = obs.select("obsnme", F.when(number < size, F.lit("long")).otherwise(F.concat(F.lit("s"), (number % 90).cast("string"))).alias("series"), (number * 0.7).alias("t"))
    one = Structure((Variogram("exponential", 1.0, 50.0),))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            found.append(wide(noise_draw(obs, series, one, 3, 4)).to_numpy())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert np.allclose(found[0], found[1], atol=1e-12)
    x = found[0][:, :size]
    assert abs((x[:, 1:] * x[:, :-1]).mean() - np.exp(-0.7 / 50)) < 0.05 and abs(x.std() - 1) < 0.05


def test_bounds_and_one_sided(spark):
    obs = spark.createDataFrame(
        [("a", "g", 1.0, 1.0, 0.5, 1.2), ("b", "less_x", 2.0, 1.0, None, None), ("c", "greater_x", 3.0, 1.0, None, None), ("d", "g", 4.0, 1.0, 3.5, None)],
        "obsnme string, obgnme string, obsval double, weight double, lower_bound double, upper_bound double")
    series = spark.createDataFrame([("a", "s", 0.0), ("b", "s", 1.0), ("c", "s", 2.0)], "obsnme string, series string, t double")
    one = Structure((Variogram("exponential", 1.0, 2.0),))
    x = wide(noise_draw(obs, series, one, 500, 3, enforce_bounds=True))
    assert (x["b"] == 2.0).all() and (x["c"] == 3.0).all()
    assert x["a"].min() == 0.5 and x["a"].max() == 1.2 and x["d"].min() == 3.5 and x["d"].max() > 4
    y = wide(noise_draw(obs, series, one, 500, 3, draw_one_sided=True))
    assert y["b"].std() > 0.5 and y["a"].min() < 0.5 and np.allclose(y["d"].clip(3.5), x["d"])


@pytest.mark.parametrize("entry,message", [(("zz", "s", 1.0), "no observation"), (("off", "s", 1.0), "no observation"), (("a", "s", None), "no time for a")])
def test_wrong_series(spark, entry, message):
    obs = spark.createDataFrame([("a", "g", 1.0, 1.0), ("off", "g", 1.0, 0.0)], "obsnme string, obgnme string, obsval double, weight double")
    series = spark.createDataFrame([entry], "obsnme string, series string, t double")
    one = Structure((Variogram("exponential", 1.0, 2.0),))
    with pytest.raises(Exception, match=message):
        noise_draw(obs, series, one, 2, 1).collect()
    with pytest.raises(ValueError, match="not exponential"):
        noise_draw(obs, series, Structure((Variogram("spherical", 1.0, 2.0),)), 2, 1)


def test_no_observations(spark):
    obs = spark.createDataFrame([], "obsnme string, obgnme string, obsval double, weight double")
    series = spark.createDataFrame([], "obsnme string, series string, t double")
    assert noise_draw(obs, series, NESTED, 2, 1).count() == 0
