"""Mixing sources to target weights along a curriculum.

A source's weight is a piecewise linear schedule over training time 0 to 1. Its integral is the source's share; the running
integral, scaled to the target, is its demand. The documents of a source lie one after the other, in hash order, on its word
axis, pass after pass; a document is taken in every pass in which its middle lies before the target. Inverting the demand at
the start of each taken copy gives its training position, and the mix is range-sorted by position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookcal.session import cut_lineage

#: Weights of the sources in code point order, repeating, and how each weight moves between start and end of training.
WEIGHTS = (5.0, 2.0, 1.0)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Sources are configuration, as are their weights; more of them are refused.
MAX_SOURCES = 100_000
#: Stretches of a source's axis that are ordered apart from each other, at least.
LEAST_BUCKETS = 64
PLAN = "source string, source_size long, target double, times array<double>, weights array<double>, reached array<double>"


@dataclass(frozen=True)
class Schedule:
    """Weights at ascending times from 0 to 1, linear in between."""

    times: tuple[float, ...]
    weights: tuple[float, ...]

    def __post_init__(self):
        if len(self.times) != len(self.weights) or self.times[0] != 0 or self.times[-1] != 1 or min(self.weights) < 0:
            raise ValueError("a schedule needs a weight of 0 or more at each time, from 0 to 1")
        if any(b <= a for a, b in zip(self.times, self.times[1:])):
            raise ValueError("times must ascend")

    def reached(self) -> list[float]:
        """The integral up to each time."""
        total = [0.0]
        for i in range(1, len(self.times)):
            total.append(total[-1] + (self.times[i] - self.times[i - 1]) * (self.weights[i] + self.weights[i - 1]) / 2)
        return total


def repeating_schedules(sources: list[str | None]) -> dict[str | None, Schedule]:
    """Weights 5, 2, 1 by code point, NULL last, on rising, steady and falling ramps of the same integral."""
    ordered = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {
        s: Schedule((0.0, 1.0), tuple(WEIGHTS[i % len(WEIGHTS)] * r for r in RAMPS[i % len(RAMPS)]))
        for i, s in enumerate(ordered)
    }


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = 3.0) -> dict[str | None, float]:
    """Shares of all words by weight; a target stops at ``most`` times its source, the excess is shared again by weight."""
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), dict(weights)
    while open_:
        total = sum(open_.values())
        above = [s for s, w in open_.items() if total <= 0 or left * w / total > most * sizes[s]]
        if not above:
            return out | {s: left * w / total for s, w in open_.items()}
        for s in above:
            out[s] = min(most * sizes[s], left) if total > 0 else 0.0
            left -= out[s]
            del open_[s]
    return out


def _time_of(words: Column) -> Column:
    """Training time at which a source's demand reaches ``words``: inverse of the running integral of its schedule."""
    share = words * F.element_at("reached", -1) / F.col("target")
    k = F.greatest(F.lit(1), F.least(F.size("times") - 1, F.size(F.filter("reached", lambda r: r <= share))))
    t, w = F.element_at("times", k), F.element_at("weights", k)
    over = F.greatest(F.lit(0.0), share - F.element_at("reached", k))
    slope = (F.element_at("weights", k + 1) - w) / (F.element_at("times", k + 1) - t)
    root = w + F.sqrt(F.greatest(F.lit(0.0), w * w + 2 * slope * over))
    return F.least(F.lit(1.0), t + F.when(root > 0, 2 * over / root).otherwise(0.0))


def plan_mix(
    docs: DataFrame, schedules=repeating_schedules, most: float = 3.0, rows_per_bucket: int = 50_000, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, offset, positions``, and ``keep`` as the struct ``row``; a row per document.

    ``size`` counts words (NULL and blank texts: 0, they are never taken). ``offset`` is the place on the source's axis, which
    documents with words do not share. ``positions`` holds the training time of each
    copy. NULL is a source of its own. Equal rows stand next to each other in the order and may differ in their copies. An
    empty table gives no rows. ``rows_per_bucket`` bounds what is sorted together and has no influence on the result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("key"),
        F.coalesce(F.regexp_count(text_col, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("at"),
        *([F.struct(*keep).alias("row")] if keep else []),
    )
    compact = cut_lineage(rows.drop("row"))
    rows = rows if keep else compact
    per_source = compact.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["size"] for r in per_source}
    chosen = schedules(list(sizes)) if callable(schedules) else schedules
    wanted = targets(sizes, {s: chosen[s].reached()[-1] for s in sizes}, most)
    plan = spark.createDataFrame(
        [(s, sizes[s], float(wanted[s]), list(chosen[s].times), list(chosen[s].weights), chosen[s].reached()) for s in sizes], PLAN,
    )
    buckets = max(LEAST_BUCKETS, sum(r["n"] for r in per_source) // rows_per_bucket)
    # bucket by position in hash order: buckets are consecutive stretches of a source's axis
    bucket = F.floor((F.col("at") / F.lit(2.0 ** 64) + 0.5) * buckets)
    rows = rows.withColumn("bucket", bucket)
    totals = compact.withColumn("bucket", bucket).groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select("key", "bucket", (F.sum("words").over(earlier) - F.col("words")).alias("base"))
    plan = plan.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), *plan.columns[1:])
    within = Window.partitionBy("key", "bucket").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("start", F.sum("size").over(within) - F.col("size")).join(
        totals.join(plan, "key"), ["key", "bucket"],
    ).withColumn("offset", F.col("base") + F.col("start"))
    middle = F.col("offset") + F.col("size") / 2
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / F.col("source_size")))).otherwise(0)
    placed = placed.withColumn("copies", copies.cast("int"))
    return placed.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "offset",
        F.when(F.col("copies") > 0, F.transform(
            F.sequence(F.lit(0), F.col("copies") - 1), lambda k: _time_of(F.col("offset") + k * F.col("source_size")),
        )).otherwise(F.array().cast("array<double>")).alias("positions"),
        *(["row"] if keep else []),
    )


def _in_order(copies: DataFrame, spark: SparkSession, *ties: str) -> DataFrame:
    """``copies`` with ``position`` and ``tie``, range-sorted by training position; ``ties`` decide what is left."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionByRange(parts, "position", "tie", *ties).sortWithinPartitions("position", "tie", *ties)


def mix(docs: DataFrame, schedules=repeating_schedules, most: float = 3.0, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per taken copy, range-sorted by training position."""
    planned = plan_mix(docs, schedules, most, keep=tuple(docs.columns), **how)
    copies = planned.select("row", F.xxhash64("doc_id").alias("tie"), F.explode("positions").alias("position"))
    return _in_order(copies, docs.sparkSession).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mixed_documents(docs: DataFrame, schedules=repeating_schedules, most: float = 3.0, **how) -> DataFrame:
    """Per document what the mix takes of it: the columns of ``plan_mix``, with ``taken`` from the sorted copies, and ``places``.

    ``places`` are the numbers of its copies in the training order, from 0, in ascending order as ``positions`` are. The mix is
    range-sorted and numbered as ``mix`` writes it, without the texts.
    """
    spark = docs.sparkSession
    planned = cut_lineage(plan_mix(docs, schedules, most, **how))
    identity = ["source", "offset"]
    copies = planned.select(*identity, "size", F.xxhash64("doc_id").alias("tie"), F.explode("positions").alias("position"))
    ordered = cut_lineage(_in_order(copies, spark, *identity).select(
        *identity, "size", "position", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # a task's copies are numbered without gaps from the number of its partition on
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = ordered.join(F.broadcast(first), "part").withColumn("place", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    found = placed.groupBy(*identity).agg(
        F.sum("size").alias("taken"), F.sort_array(F.collect_list("place")).alias("places"))
    found = found.select(F.col("source").alias("_s"), F.col("offset").alias("_o"), F.col("taken").alias("_t"), "places")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("offset") == F.col("_o")) & (F.col("size") > 0)
    return planned.join(found, same, "left").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("_t", F.lit(0)).cast("long").alias("taken"), "offset",
        "positions", F.coalesce("places", F.array().cast("array<long>")).alias("places"))
