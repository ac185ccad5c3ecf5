import numpy as np
import pytest
from pyspark.sql import functions as F

from brookcal.operators import regime


def _sequential(q):
    """Day-by-day evaluation of the limb rules on one dense series (NaN = missing)."""
    n = len(q)
    pos = np.sort(q[q > 0])
    med = np.quantile(pos, 0.5, method="nearest") if len(pos) else np.nan
    p75 = np.quantile(pos, 0.75, method="nearest") if len(pos) else np.nan
    first = next((d for d in range(n - 1) if q[d] >= 0 and q[d + 1] >= 0), None)
    if first is None:
        return np.zeros(n, int)
    state = np.full(n, -1)
    start = 2 if (q[first] > med or q[first + 1] >= 1.25 * q[first]) else 1
    start = 3 if q[first + 1] < 0.75 * q[first] else start
    state[first : first + 2] = start
    for d in range(first + 2, n):
        was, today, before = state[d - 1], q[d], q[d - 1]
        if not today >= 0:
            continue
        if today < med:
            state[d] = 1
        elif was == 1:
            state[d] = 2 if today > p75 or (today > med and today > 1.25 * before) else 1
        elif was == 2:
            state[d] = 2 if today > 0.9 * before else 3
        elif was == 3:
            state[d] = 3 if today > p75 or not today < 0.9 * before else 1
    return state


def _series():
    rng = np.random.default_rng(11)
    out = {}
    for i in range(25):
        n = int(rng.integers(2, 500))
        q = np.round(np.abs(np.cumsum(rng.normal(0, 2, n))) * rng.choice([1, 3]), 1)
        q[rng.random(n) < rng.choice([0, 0.05, 0.3])] = np.nan
        q[rng.random(n) < 0.05] = -1.0
        q[rng.random(n) < 0.05] = 0.0
        out[f"g{i:02d}"] = q
    out["no_positive"] = np.zeros(40)
    out["one_valid_day"] = np.array([np.nan, 3.0, np.nan, np.nan])
    out["constant"] = np.full(200, 7.0)
    out["exact_steps"] = np.array([4.0, 5.0, 4.5, 4.05, 4.0, 5.0, 6.25, 5.625, 5.0, 2.0, 2.5, 3.0] * 20)
    return out


@pytest.mark.parametrize("drop_gaps", [False, True])
def test_limb_states_match_day_by_day_rules(spark, drop_gaps):
    start = np.datetime64("2001-11-15")
    data = _series()
    rows = [
        (k, str(start + i), None if np.isnan(v) else float(v))
        for k, q in data.items() for i, v in enumerate(q) if not (drop_gaps and np.isnan(v))
    ]
    df = spark.createDataFrame(rows, "loc string, day string, discharge double").withColumn("day", F.to_date("day"))
    got = {}
    for r in regime.limb_states(df).collect():
        got[(r["loc"], str(r["day"]))] = r["high_low"]
    assert len(got) == len(rows)
    for k, q in data.items():
        want = _sequential(q)
        for i, v in enumerate(q):
            if drop_gaps and np.isnan(v):
                continue
            assert got[(k, str(start + i))] == want[i], (k, i)


def test_flow_class_rules(spark):
    rows = [(5.0, 12.0, 2), (5.0, 3.0, 3), (5.0, None, 2), (0.5, None, 1), (1.0, None, 1), (-1.0, None, -1), (None, None, -1), (2.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "q double, ri double, hl int").withColumn(
        "c", regime.flow_class(F.col("q"), F.col("ri"), F.col("hl"), F.lit(1.0)))
    assert [r["c"] for r in df.collect()] == [1, 2, 3, 5, 4, -1, -1, 0]


def test_ranks_and_thresholds_with_ties_over_many_ranges(spark):
    """A gauge that holds most of the rows, few distinct flows, missing and negative days."""
    rng = np.random.default_rng(4)
    start = np.datetime64("1990-01-01")
    sizes = {"hot": 4000, "small": 30, "one": 1, "dry": 20}
    rows = []
    for loc, n in sizes.items():
        for i in range(n):
            q = float(rng.integers(-1, 12)) if loc != "dry" else 0.0
            rows.append((loc, str(start + i), None if q == 3 else 5.0 if loc == "one" else q))
    df = spark.createDataFrame(rows, "loc string, day string, discharge double").withColumn("day", F.to_date("day"))
    got = {(r["loc"], str(r["day"])): r for r in regime.with_ranks(df).collect()}
    assert len(got) == len(rows)
    for loc in sizes:
        down = sorted(((q, day) for x, day, q in rows if x == loc and q is not None and q > 0), reverse=True)
        place = {day: i + 1 for i, (_, day) in enumerate(down)}
        up = [q for q, _ in reversed(down)]
        cuts = [up[int(np.rint((len(up) - 1) * p))] if up else None for p in (0.1, 0.5, 0.75)]
        for x, day, _ in rows:
            if x == loc:
                r = got[(loc, day)]
                assert r["rank"] == place.get(day) and r["n_positive"] == (len(down) if day in place else None)
                assert [r["p10"], r["median"], r["p75"]] == cuts
