"""Consistent-hash ring with virtual nodes and bounded loads.

Every row has a position on the ring, every shard owns ``vnodes`` points of it. Rows are admitted in ring order; a row goes
to the first shard clockwise that still has room. Because admission follows the ring, the whole outcome depends only on the
number of rows between neighbouring ring points: one count per arc (``shards * vnodes`` of them, whatever the data) is
walked on the driver, and the walk returns at most three cuts per arc. The rows themselves never leave the cluster.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookcal.session import cut_lineage

SEGMENTS = "arc long, first long, stop long, shard int, base long"


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, list[int]]:
    """Sorted ring points (signed 64-bit) and the shard that owns each of them."""
    points = sorted(
        (xxhash.xxh64_intdigest(f"shard {s} point {v}".encode()) - (1 << 63), s)
        for s in range(shards) for v in range(vnodes)
    )
    return np.array([p for p, _ in points], dtype=np.int64), [s for _, s in points]


def capacities(rows: int, shards: int, headroom: float = 1.0) -> list[int]:
    """Rows a shard may hold. Without headroom they add up to ``rows``, so that counts differ by one at most."""
    if headroom < 1:
        raise ValueError("headroom below 1 leaves rows without a shard")
    if headroom == 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(-(-rows * headroom // shards))] * shards


def walk(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Cuts (arc, first, stop, shard, base): rows ``first`` to ``stop`` of an arc lie in ``shard`` from slot ``base`` on."""
    room, used = list(room), [0] * len(room)
    waiting: deque[list[int]] = deque()
    cuts = []
    for step in range(2 * len(owners)):
        arc = step % len(owners)
        if step < len(owners):
            if counts.get(arc):
                waiting.append([arc, 0, counts[arc]])
        elif not waiting:
            break
        shard = owners[arc]
        while waiting and room[shard]:
            source, first, stop = waiting[0]
            take = min(room[shard], stop - first)
            cuts.append((source, first, first + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
            if first + take == stop:
                waiting.popleft()
            else:
                waiting[0][1] += take
    return cuts


def shard_rows(
    docs: DataFrame, shards: int, vnodes: int = 256, headroom: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Shard index of ``docs``: ``doc_id, size, text_crc32, shard, slot``, one row per row of ``docs``.

    ``size`` is the UTF-8 length of the text (NULL: none) plus 16. The ring key is id and text, so a NULL or often repeated
    id spreads; rows equal in both are counted before they are shuffled and then take consecutive slots. NULL and empty
    texts differ on the ring only. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    points, owners = ring(shards, vnodes)

    @F.pandas_udf("long")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, position.to_numpy(), side="left") % len(points))

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("position"),
    )
    same = ["doc_id", "size", "text_crc32", "position"]
    rows = cut_lineage(
        rows.groupBy(*same).agg(F.count("*").alias("copies")).withColumn("arc", arc_of("position"))
    )
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}
    cuts = walk(counts, owners, capacities(sum(counts.values()), shards, headroom))

    order = Window.partitionBy("arc").orderBy("position", "doc_id", "size", "text_crc32")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = 4096
    placed = (
        rows.withColumn("rank", F.sum("copies").over(before) - F.col("copies"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("long"), F.lit(block))))
        .withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + block, F.col("copies")) - 1)))
        .withColumn("rank", F.col("rank") + F.col("copy"))
    )
    plan = docs.sparkSession.createDataFrame(cuts, SEGMENTS).alias("plan")
    return placed.alias("row").join(
        plan,
        (F.col("row.arc") == F.col("plan.arc")) & (F.col("row.rank") >= F.col("plan.first"))
        & (F.col("row.rank") < F.col("plan.stop")),
    ).select(
        "row.doc_id", "row.size", "row.text_crc32", "plan.shard",
        (F.col("plan.base") + F.col("row.rank") - F.col("plan.first")).alias("slot"),
    )
