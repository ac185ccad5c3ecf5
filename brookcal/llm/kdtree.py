"""Exact top-k inner products with one KD-tree per shard.

Rows are dealt evenly into shards of bounded size; each shard's tree splits at medians of its widest dimension and keeps the
tight bounding box of every node. A query walks a tree best first: the largest inner product that a box allows says which node
comes next and when none can matter. The shards of one lane are searched after each other, and a query's kth score so far goes
along, so later trees are cut earlier. Lanes run in parallel; their short lists are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookcal.session import cut_lineage

SHARD_ROWS = 8_192
LANE_SHARDS = 4
BLOCK_QUERIES = 4_096
LEAF = 64
HITS = "query_id long, vec_id long, score long"


@dataclass
class KDTree:
    """Points in leaf order; node ``i`` holds points ``first[i]`` to ``stop[i]`` and has children ``left[i]``, ``left[i] + 1``."""

    ids: np.ndarray
    points: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> "KDTree":
        order = np.argsort(ids, kind="stable")
        nodes = [[0, len(ids), -1]]
        lows, highs = [], []
        at = 0
        while at < len(nodes):
            a, b, _ = nodes[at]
            own = points[order[a:b]]
            lows.append(own.min(axis=0))
            highs.append(own.max(axis=0))
            width = highs[-1] - lows[-1]
            if b - a > leaf and len(width) and width.max() > 0:
                dimension, middle = int(width.argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, dimension], middle, kind="introselect")]
                nodes[at][2] = len(nodes)
                nodes += [[a, a + middle, -1], [a + middle, b, -1]]
            at += 1
        first, stop, left = (np.array(c) for c in zip(*nodes))
        return cls(ids[order], points[order], first, stop, left, np.array(lows), np.array(highs))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: list[list[tuple[int, int]]], k: int) -> None:
        """Merges each query's best into ``best``: heaps of (score, -id), the kth on top."""
        above, below = self.high.T.astype("<f8"), self.low.T.astype("<f8")
        bounds = np.maximum(queries, 0).astype("<f8") @ above + np.minimum(queries, 0).astype("<f8") @ below
        if queries.dtype.kind == "i":
            # integer scores may pass what a double holds exactly; the bounds are doubles and take the rounding on top
            bounds += 1e-12 * (np.abs(queries).astype("<f8") @ np.maximum(np.abs(above), np.abs(below))) + 1
        for q in range(len(query_ids)):
            heap, bound, own = best[q], bounds[q], query_ids[q]
            todo = [(-bound[0], 0)]
            while todo:
                upper, node = heapq.heappop(todo)
                if len(heap) == k and -upper < heap[0][0]:
                    break
                child = self.left[node]
                if child >= 0:
                    for c in (child, child + 1):
                        if len(heap) < k or bound[c] >= heap[0][0]:
                            heapq.heappush(todo, (-bound[c], int(c)))
                    continue
                a, b = self.first[node], self.stop[node]
                scores = self.points[a:b] @ queries[q]
                near = np.flatnonzero(scores >= heap[0][0]) if len(heap) == k else np.arange(b - a)
                for i in near:
                    if self.ids[a + i] == own:
                        continue
                    entry = (scores[i], -int(self.ids[a + i]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)


def _pack(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def top_k(
    vectors: DataFrame, k: int = 10, scale: float = 1024.0, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each row whose id is divisible by ``every``.

    Components become ``floor(scale * x)``, ``x`` as double, the score is their inner product, ties go to the smaller id. A row
    is no candidate of a query with its own id. Vectors that are NULL or hold NULL or non-finite components, and rows without
    id, take no part. Shorter vectors count as filled with zeros. A query id that occurs with several vectors gets the best
    scores of any of them; a repeated candidate takes several ranks. Products that may pass 2^53 are summed as 64-bit integers; where a score might not fit into those, an
    error says so.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))).alias("most")).first()
    if not about["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = about["width"]
    reach = about["most"] ** 2 * max(width, 1)
    if reach >= 2.0 ** 63:
        raise ValueError("inner products of these vectors do not fit into 64 bits")
    kind = "<f8" if reach < 2.0 ** 53 else "<i8"
    shards = -(-about["n"] // SHARD_ROWS)
    lanes = -(-shards // LANE_SHARDS)

    def matrix(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), width), dtype=kind)
        for i, v in enumerate(column.to_pylist()):
            out[i, : len(v)] = v
        return out

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)), b.column(2)) for b in batches if b.num_rows]
        if not parts:
            return
        tree = KDTree.build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        shard = parts[0][2][0].as_py()
        yield pa.RecordBatch.from_pydict({
            "lane": pa.array([shard % lanes], pa.int32()), "ids": pa.array([tree.ids.tobytes()], pa.binary()),
            "points": pa.array([_pack(tree.points, kind)], pa.binary()), "nodes": pa.array([np.array([tree.first, tree.stop, tree.left], dtype="<i8").tobytes()], pa.binary()),
            "boxes": pa.array([_pack(np.array([tree.low, tree.high]), kind)], pa.binary()),
        })

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_QUERIES):
                some = b.slice(at, BLOCK_QUERIES)
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([some.column(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                    "points": pa.array([_pack(matrix(some.column(1)), kind)], pa.binary()),
                })

    trees = cut_lineage(
        rows.repartition(shards).withColumn("shard", F.spark_partition_id())
        .mapInArrow(grow, "lane int, ids binary, points binary, nodes binary, boxes binary")
    )
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    questions = max(1, -(-asked.count() // BLOCK_QUERIES))
    blocks = cut_lineage(asked.repartition(questions).mapInArrow(block, "ids binary, points binary").withColumn("block", F.monotonically_increasing_id()))
    # every block of queries goes to every lane; both sides are packed
    right = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    asked_of = blocks.select(F.col("block").alias("of_block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("of_lane"))
    left = trees.join(asked_of, F.col("lane") == F.col("of_lane")).drop("lane")

    def search(key, tree_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in query_rows.itertuples():
            query_ids = np.frombuffer(q.ids, dtype="<i8")
            queries = np.frombuffer(q.points, dtype=kind).reshape(len(query_ids), width)
            best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
            for t in tree_rows.itertuples():
                ids = np.frombuffer(t.ids, dtype="<i8")
                nodes = np.frombuffer(t.nodes, dtype="<i8").reshape(3, -1)
                boxes = np.frombuffer(t.boxes, dtype=kind).reshape(2, nodes.shape[1], width)
                points = np.frombuffer(t.points, dtype=kind).reshape(len(ids), width)
                KDTree(ids, points, *nodes, *boxes).search(query_ids, queries, best, k)
            out += [(int(i), -e[1], int(e[0])) for i, heap in zip(query_ids, best) for e in heap]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    hits = left.groupBy("of_lane", "of_block").cogroup(right.groupBy("lane", "block")).applyInPandas(search, HITS)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
