"""Row numbers and neighbours along an order, without one task per group.

A window over a group sends the whole group to one task. Here rows are range
partitioned on (group, order) - a large group spreads over many ranges - and
the range number takes the place of the group. Only one row per range crosses
the range borders. Ranges are materialised once, because their bounds are
sampled and both readers must see the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookcal.session import cut_lineage


def range_chunks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``_chunk``, a range number that rises with ``order``."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))


def global_row_number(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """1-based position of every row in the total order."""
    rows = range_chunks(df, order)
    sizes = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select("_chunk", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    return (
        rows.withColumn("_local", local).join(starts, "_chunk")
        .withColumn(name, F.col("_start") + F.col("_local")).drop("_chunk", "_start", "_local")
    )


def lead_in_group(df: DataFrame, group: str, order: str, columns: Sequence[str], prefix: str = "next_") -> DataFrame:
    """Adds the next row's ``columns`` in the order of each group; NULL on the last row."""
    rows = range_chunks(df, [group, order])
    packed = F.struct(*columns)
    w = Window.partitionBy("_chunk", group).orderBy(order)
    inside = rows.withColumn("_next", F.lead(packed).over(w))
    firsts = rows.groupBy(group, "_chunk").agg(F.min_by(packed, order).alias("_first"))
    border = firsts.select(
        group, "_chunk", F.lead("_first").over(Window.partitionBy(group).orderBy("_chunk")).alias("_border"))
    out = inside.join(border, [group, "_chunk"])
    pick = F.coalesce("_next", "_border")
    return out.select(*df.columns, *[pick[c].alias(f"{prefix}{c}") for c in columns])


def number_in_group(df: DataFrame, group: str, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """0-based position of every row in the order of its group."""
    rows = global_row_number(df, [group, *order], "_g")
    first = rows.groupBy(group).agg(F.min("_g").alias("_f"))
    return rows.join(first, group).withColumn(name, F.col("_g") - F.col("_f")).drop("_g", "_f")
