"""Exact order statistics that never hold one key's rows in one task.

``percentile`` keeps every distinct value of a key in a single hash map, and a
window over the key sends all its rows to a single task. Both fail when one
key holds a large part of the table. Here a key is cut into many small value
buckets first: counts per bucket combine map-side, the offset of a bucket is a
running sum over few buckets, and only the buckets that contain a wanted rank
are looked at row by row. A bucket that holds many rows, as with values of a
narrow range, is cut again between its own extremes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 256
CELL = 1024


def value_bucket(value: Column) -> Column:
    """Order-preserving bucket number of a double, independent of the data.

    Every octave of the range of a double, the tiniest included, has
    ``BUCKETS_PER_OCTAVE`` buckets on each side of zero; zero and the
    infinities have their own.
    """
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    place = F.when(size == float("inf"), F.lit(1100.0)).otherwise(octave + size / F.pow(F.lit(2.0), octave) - 1.0)
    bucket = F.floor((place + 1076.0) * float(BUCKETS_PER_OCTAVE))
    return F.when(value == 0, F.lit(0)).when(value < 0, -bucket).otherwise(bucket).cast("long")


def _cell(value: Column, lo: Column, hi: Column, rows: Column) -> Column:
    """Second cut, taken from the data: a bucket of many rows falls into equal steps between its extremes."""
    steps = F.ceil(rows / F.lit(float(CELL)))
    at = F.floor((value - lo) / (hi - lo) * steps)
    return F.when((steps <= 1) | (lo == hi), F.lit(0)).otherwise(F.least(at, steps - 1)).cast("long")


def _position(total: Column, prob: float) -> Column:
    return (total - F.lit(1)) * F.lit(float(prob))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    method: str = "linear",
) -> DataFrame:
    """One row per key with the requested exact quantiles as columns.

    ``method='linear'`` interpolates between neighbours, ``'nearest'`` takes the
    element at the half-to-even rounded position. NULL and NaN are skipped.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown quantile method: {method}")
    keys = list(keys)
    # NaN is a missing value, not one above all others
    df = df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")))
    rows = (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"), value_bucket(F.col(value).cast("double")).alias("_b"))
    )
    by_key = Window.partitionBy(*keys)
    running = Window.unboundedPreceding, 0
    wanted = []
    for prob in probs.values():
        pos = _position(F.col("_total"), prob)
        wanted += [F.rint(pos)] if method == "nearest" else [F.floor(pos), F.ceil(pos)]
    positions = F.array(*[w.cast("long") for w in wanted])
    hit = F.exists(positions, lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")))
    buckets = (
        rows.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumns({
            "_before": F.sum("_n").over(by_key.orderBy("_b").rowsBetween(*running)) - F.col("_n"),
            "_total": F.sum("_n").over(by_key),
        })
        .where(hit)
    )
    facts = ["_before", "_total"]
    values = (
        rows.join(buckets, [*keys, "_b"])
        .groupBy(*keys, "_b", _cell(F.col("_v"), F.col("_lo"), F.col("_hi"), F.col("_n")).alias("_s"), "_v", *facts)
        .agg(F.count(F.lit(1)).alias("_m"))
    )
    steps = Window.partitionBy(*keys, "_b").orderBy("_s")
    cells = (
        values.groupBy(*keys, "_b", "_s", *facts).agg(F.sum("_m").alias("_n"))
        .withColumn("_before", F.col("_before") + F.sum("_n").over(steps.rowsBetween(*running)) - F.col("_n"))
        .where(hit).select(*keys, "_b", "_s", "_before")
    )
    inside = Window.partitionBy(*keys, "_b", "_s").orderBy("_v")
    picks = (
        values.drop("_before").join(cells, [*keys, "_b", "_s"])
        .withColumn("_end", F.col("_before") + F.sum("_m").over(inside.rowsBetween(*running)))
        .withColumn("_start", F.col("_end") - F.col("_m"))
    )

    def at(pos: Column) -> Column:
        covers = (pos >= F.col("_start")) & (pos < F.col("_end"))
        return F.max(F.when(covers, F.col("_v")))

    aggs = []
    for name, prob in probs.items():
        pos = _position(F.col("_total"), prob)
        if method == "nearest":
            aggs.append(at(F.rint(pos).cast("long")).alias(name))
        else:
            lo, hi = at(F.floor(pos)), at(F.ceil(pos))
            frac = F.max(pos - F.floor(pos))
            aggs.append((lo + (hi - lo) * frac).alias(name))
    return picks.groupBy(*keys).agg(*aggs)


def descending_rank(df: DataFrame, key: str, value: str, day: str, source: DataFrame | None = None) -> DataFrame:
    """Adds ``rank`` (1 = largest positive value, ties broken by latest day) and
    ``n_positive`` to every row of ``df``; both are NULL on rows without a
    positive value. The counts may be taken from ``source``, the same rows
    before ``df`` was derived from them.

    Rows are counted per (key, bucket, value, year) before anything is ordered,
    so a window never sees more than the distinct values of one cell of a
    bucket or the days of one year.
    """
    rows = df.withColumn("_y", F.year(day))
    counted = rows if source is None else source.withColumn("_y", F.year(day))
    ties = (
        counted.where(F.col(value) > 0)
        .groupBy(key, F.col(value).alias("_v"), "_y")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    by_key = Window.partitionBy(key)
    running = Window.unboundedPreceding, 0
    buckets = (
        ties.groupBy(key, "_b")
        .agg(F.sum("_n").alias("_bn"), F.count(F.lit(1)).alias("_ties"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_off", F.sum("_bn").over(by_key.orderBy(F.desc("_b")).rowsBetween(*running)) - F.col("_bn"))
        .withColumn("n_positive", F.sum("_bn").over(by_key))
    )
    placed = ties.join(buckets, [key, "_b"]).withColumn("_s", _cell(F.col("_v"), F.col("_lo"), F.col("_hi"), F.col("_ties")))
    down = Window.partitionBy(key, "_b").orderBy(F.desc("_s"))
    cells = (
        placed.groupBy(key, "_b", "_s").agg(F.sum("_n").alias("_cn"))
        .withColumn("_above", F.sum("_cn").over(down.rowsBetween(*running)) - F.col("_cn"))
        .drop("_cn")
    )
    before = Window.partitionBy(key, "_b", "_s").orderBy(F.desc("_v"), F.desc("_y"))
    within = placed.join(cells, [key, "_b", "_s"]).withColumn("_in", F.sum("_n").over(before.rowsBetween(*running)) - F.col("_n"))
    base = within.select(key, "_v", "_y", (F.col("_off") + F.col("_above") + F.col("_in")).alias("_start"), "n_positive")
    tie = Window.partitionBy(key, value, "_y").orderBy(F.desc(day))
    return (
        rows.join(base.withColumnRenamed("_v", value), [key, value, "_y"], "left")
        .withColumn("rank", F.col("_start") + F.row_number().over(tie))
        .drop("_start", "_y")
    )
