"""Flow regimes of daily gauge series: recurrence, limb state, flow class.

Input is ``(loc, day, discharge)`` with NULL for missing days; a day without a
row counts as missing too. Nothing here groups by gauge alone: work is cut by
(gauge, quarter), and the state of one quarter reaches the next one through a
composed transition table of five entries. Ranks and thresholds come from one
range sort, in which a gauge of any length spreads over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookcal.functions.order_stats import descending_rank, exact_quantiles
from brookcal.session import cut_lineage, spread

DAYS_PER_YEAR = 365.0
# Limb states: 0 invalid, 1 low flow, 2 ascending, 3 descending, 4 before the first two valid days. In tables and folds a
# state stands as its place in the table: five bits a state, so a step is one shift.
_BEFORE, _BITS = 4, 5
_PROBS = {"p10": 0.1, "median": 0.5, "p75": 0.75}


def recurrence_interval(flow: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``ri`` in years: (n_positive/365 + 1) / rank, NULL without positive flow."""
    return descending_rank(flow, "loc", "discharge", "day", source).withColumn(
        "ri", (F.col("n_positive") / F.lit(DAYS_PER_YEAR) + F.lit(1.0)) / F.col("rank")
    ).drop("n_positive", "rank")


def flow_thresholds(flow: DataFrame) -> DataFrame:
    """Nearest-rank p10, median and p75 of the positive flows of each gauge."""
    return exact_quantiles(
        flow.where(F.col("discharge") > 0),
        ["loc"], "discharge", _PROBS, method="nearest",
    )


def _quarter(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day)


def with_calendar_neighbours(flow: DataFrame) -> DataFrame:
    """Adds ``prev_q``, ``has_prev`` and ``next_q`` from the adjacent calendar days.

    The first and last day of a quarter are copied into the quarter next to
    theirs, so one shuffle on (loc, quarter) is enough.
    """
    q = _quarter(F.col("day"))
    home = F.struct(q.alias("chunk"), F.lit(False).alias("copy"))
    copies = F.filter(
        F.array(
            home,
            F.when(_quarter(F.date_add("day", 1)) != q, F.struct((q + 1).alias("chunk"), F.lit(True).alias("copy"))),
            F.when(_quarter(F.date_sub("day", 1)) != q, F.struct((q - 1).alias("chunk"), F.lit(True).alias("copy"))),
        ),
        lambda c: c.isNotNull(),
    )
    w = Window.partitionBy("loc", "chunk").orderBy("day")
    before, after = F.lag("day").over(w), F.lead("day").over(w)
    adjacent_before = F.coalesce(F.date_diff("day", before) == 1, F.lit(False))
    rows = flow.select("*", F.explode(copies).alias("_c")).select(
        *flow.columns, F.col("_c.chunk").alias("chunk"), F.col("_c.copy").alias("_copy"),
    )
    return (
        spread(rows, "loc", "chunk")
        .withColumns({
            "has_prev": adjacent_before,
            "prev_q": F.when(adjacent_before, F.lag("discharge").over(w)),
            "next_q": F.when(F.date_diff(after, F.col("day")) == 1, F.lead("discharge").over(w)),
        })
        .where(~F.col("_copy"))
        .drop("_copy")
    )


def first_valid_day(flow: DataFrame) -> DataFrame:
    """First day whose own and next day's flow are both valid (>= 0), per gauge."""
    valid = (F.col("discharge") >= 0) & (F.col("next_q") >= 0)
    return with_calendar_neighbours(flow).where(valid).groupBy("loc").agg(F.min("day").alias("first_day"))


def with_ranks(flow: DataFrame) -> DataFrame:
    """Adds ``rank`` (1 = largest positive flow, ties broken by latest day), ``n_positive``, ``p10``, ``median`` and ``p75``.

    Rows are sorted once on (gauge, flow, day). A range holds a consecutive stretch of a gauge, so the place of a row in
    its range and the counts of the ranges before are its rank, and the ranges also say where the rows of the wanted
    quantiles stand. ``rank`` is NULL on days without a positive flow, the thresholds on gauges without such a day.
    """
    value = F.when(~F.isnan("discharge") & (F.col("discharge") > 0), F.col("discharge"))
    order = [F.col("loc"), F.col("_v").desc_nulls_last(), F.col("day").desc()]
    rows = flow.withColumn("_v", value).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(rows.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    rows = rows.repartition("loc", "_range")
    counts = rows.groupBy("loc", "_range").agg(F.count("_v").alias("_n"), F.min("_at").alias("_low"))
    gauge = Window.partitionBy("loc")
    before = gauge.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = counts.select(
        "loc", "_range", "_low", (F.sum("_n").over(before) - F.col("_n")).alias("_above"), F.sum("_n").over(gauge).alias("n_positive"),
    )
    rank = F.when(F.col("_v").isNotNull(), F.col("_above") + F.col("_at") - F.col("_low") + 1)
    numbered = rows.join(ranges, ["loc", "_range"]).withColumn("rank", rank)
    # nearest rank, counted from the largest
    wanted = {name: F.col("n_positive") - F.rint((F.col("n_positive") - 1) * F.lit(p)) for name, p in _PROBS.items()}
    hit = F.col("rank").isin(*wanted.values())
    cuts = numbered.where(hit).groupBy("loc").agg(*[F.max(F.when(F.col("rank") == w, F.col("_v"))).alias(n) for n, w in wanted.items()])
    known = ranges.join(cuts, "loc", "left")
    return (
        rows.join(known, ["loc", "_range"]).withColumn("rank", rank)
        .withColumn("n_positive", F.when(F.col("rank").isNotNull(), F.col("n_positive")))
        .select(*flow.columns, "rank", "n_positive", *_PROBS)
    )


def _opening(first: Column, then: Column) -> Column:
    """State of the first two valid days; NULL where one of them is not valid."""
    state = F.when(then < first * 0.75, 3).when((first > F.col("median")) | (then >= first * 1.25), 2).otherwise(1)
    return F.when((first >= 0) & (then >= 0), state)


def _transition_code() -> Column:
    """Place of the next state for each possible previous state, five bits per previous state."""
    q, prev = F.col("discharge"), F.col("prev_q")
    yes = lambda c: F.coalesce(c, F.lit(False))
    low = yes(q < F.col("median"))
    high = yes(q > F.col("p75"))
    from_low = F.when(high | (yes(q > F.col("median")) & yes(q > prev * 1.25)), 2).otherwise(1)
    from_rise = F.when(yes(q > prev * 0.9), 2).otherwise(3)
    from_fall = F.when(~high & yes(q < prev * 0.9), 1).otherwise(3)
    later = lambda c: F.when(~yes(q >= 0), 0).when(low, 1).when(~F.col("has_prev"), 0).otherwise(c)
    # the second of the first two valid days ends the wait; the first one is given its state when it is played back
    begin = F.coalesce(_opening(prev, q), F.lit(_BEFORE))
    code = F.lit(0)
    for state, into in enumerate([later(F.lit(0)), later(from_low), later(from_rise), later(from_fall), begin]):
        code = code + into * F.lit(_BITS << (_BITS * state))
    return code.cast("int")


def _step(code: Column, place: Column) -> Column:
    """Apply one day's table to the place of a state."""
    return F.call_function("shiftright", code, place).bitwiseAND(F.lit(31))


def _fold(days: str) -> Column:
    """The table of consecutive days."""
    out = F.lit(0)
    for s in range(5):
        end = F.aggregate(days, F.lit(_BITS * s), lambda place, d: _step(d["code"], place))
        out = out + end * F.lit(1 << (_BITS * s))
    return out.cast("int")


def limb_states(flow: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``high_low`` per day: 1 low, 2 ascending, 3 descending, -1 invalid.

    Gauges without two consecutive valid days are not classified and hold 0.
    The sequential rule is evaluated as a parallel prefix: every quarter is
    folded into one transition table, the few tables of a gauge are chained to
    give each quarter's entry state, and the quarters are then played back.
    The wait for the first valid day is a state of its own, so nothing but the
    tables crosses the quarters. ``keep`` names further columns of ``flow`` or
    of ``with_ranks`` to carry.
    """
    payload = list(dict.fromkeys(("discharge", *keep)))
    carried = [c for c in payload if c in flow.columns]
    days = with_calendar_neighbours(with_ranks(flow.select(*dict.fromkeys(("loc", "day", *carried)))))
    chunks = days.groupBy("loc", "chunk").agg(
        F.sort_array(F.collect_list(F.struct(
            "day", _transition_code().alias("code"), _opening(F.col("discharge"), F.col("next_q")).alias("opens"), *payload,
        ))).alias("days")
    )
    # folded here and played back below: without the cut the quarters would be formed twice
    chunks = cut_lineage(chunks.withColumn("table", _fold("days")))
    tables = chunks.select("loc", "chunk", "table")
    chain = tables.groupBy("loc").agg(F.sort_array(F.collect_list(F.struct("chunk", "table"))).alias("tables"))
    entry_type = "struct<state:int,out:array<struct<chunk:int,entry:int>>>"
    walk = F.aggregate(
        "tables",
        F.struct(F.lit(_BITS * _BEFORE).alias("state"), F.array().alias("out")).cast(entry_type),
        lambda acc, t: F.struct(
            _step(t["table"], acc["state"]).cast("int").alias("state"),
            F.concat(
                acc["out"], F.array(F.struct(t["chunk"].alias("chunk"), acc["state"].alias("entry")))
            ).alias("out"),
        ).cast(entry_type),
    )
    entries = chain.select("loc", walk.alias("w")).select(
        "loc", (F.col("w.state") != _BITS * _BEFORE).alias("_ok"), F.explode("w.out").alias("e"),
    ).select("loc", "_ok", F.col("e.chunk").alias("chunk"), F.col("e.entry").alias("entry"))
    played = chunks.join(entries, ["loc", "chunk"]).select(
        "loc", "days", "_ok",
        F.aggregate(
            "days",
            F.array("entry"),
            lambda acc, d: F.concat(acc, F.array(_step(d["code"], F.element_at(acc, -1)).cast("int"))),
        ).alias("states"),
    )
    state = (F.get("states", F.col("i") + 1) / _BITS).cast("int")
    return (
        played.select("loc", "_ok", F.posexplode("days").alias("i", "d"), "states")
        .select("loc", "d.day", *[F.col(f"d.{c}").alias(c) for c in payload], "_ok", state.alias("_s"), F.col("d.opens").alias("_opens"))
        .withColumn(
            "high_low",
            F.when(~F.col("_ok"), 0).when(F.col("_s") == _BEFORE, F.coalesce("_opens", F.lit(-1)))
            .when(F.col("_s") == 0, -1).otherwise(F.col("_s")).cast("int"),
        )
        .drop("_ok", "_s", "_opens")
    )


def flow_class(discharge: Column, ri: Column, high_low: Column, p10: Column) -> Column:
    """1 large flood, 2 small flood, 3 high pulse, 4 low flow, 5 extreme low, -1 none."""
    high = F.when(ri > 10.0, 1).when(ri > 2.0, 2).otherwise(3)
    low = F.when(discharge < p10, 5).otherwise(4)
    return (
        F.when(high_low == 0, 0)
        .when((discharge >= 0) & (high_low > 1), high)
        .when((discharge >= 0) & (high_low == 1), low)
        .otherwise(-1)
        .cast("int")
    )


def classify_flow(flow: DataFrame) -> DataFrame:
    """``(loc, day, discharge, ri, high_low, efc)`` for every input day."""
    states = limb_states(flow.select("loc", "day", "discharge"), keep=("p10", "rank", "n_positive"))
    ri = (F.col("n_positive") / F.lit(DAYS_PER_YEAR) + F.lit(1.0)) / F.col("rank")
    return states.withColumn("ri", ri).select(
        "loc", "day", "discharge",
        F.when(F.col("high_low") != 0, F.col("ri")).alias("ri"),
        "high_low",
        flow_class(F.col("discharge"), F.col("ri"), F.col("high_low"), F.col("p10")).alias("efc"),
    )


def coarse_class(efc: Column, discharge: Column) -> Column:
    """High flows 6, low flows 7, unclassified 0, missing -999."""
    return (
        F.when(discharge.isNull(), -999)
        .when(efc.between(1, 3), 6)
        .when(efc.between(4, 5), 7)
        .when(efc < 0, 0)
        .otherwise(efc)
        .cast("int")
    )


def water_year(day: Column) -> Column:
    """October to December belong to the following water year."""
    return F.year(F.add_months(day, 3))
