"""Substring removal by hashing lines or paragraphs.

A text is cut into units, each with the offsets it has in the original. A line is cut further where a sentence ends, because
passages are also pasted into the middle of lines; ``unit="paragraph"`` cuts at blank lines only. Units are normalised (lower
case, single spaces) and hashed. Per digest one small record, the earliest occurrence, is aggregated before the shuffle, so a
line that a third of all documents share costs no more than any other. Every later occurrence is a repeat; neighbouring
repeats form runs, and runs of ``min_words`` words or more are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookcal.session import cut_lineage

ENDS = {"line": re.compile(r"[.!?]+(?=\s)|\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*")}


def units_of(text: str, unit: str = "line") -> list[tuple[int, int, int, bytes]]:
    """Start, end, words and digest of the units of ``text`` that have words; offsets are code points, ends exclusive."""
    out, at = [], 0
    stops = [m.end() for m in ENDS[unit].finditer(text)]
    for stop in [*stops, len(text)]:
        words = text[at:stop].lower().split()
        if words:
            out.append((at, stop, len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8"))))
        at = stop
    return out


def unit_rows(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d_id, d_tie, unit, start, stop, words, digest``: a row per unit."""
    rows = docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col)).where(F.col(text_col).isNotNull())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rows, found = 0, [], []
            for i, text in enumerate(batch.column(2)):
                own = units_of(text.as_py(), unit)
                rows += [i] * len(own)
                found += [(k, *u) for k, u in enumerate(own)]
                size += len(own)
                if size > 50_000 or i + 1 == batch.num_rows:
                    at = pa.array(rows, pa.int32())
                    cols = list(zip(*found)) or [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.binary())],
                        names=["d_id", "d_tie", "unit", "start", "stop", "words", "digest"],
                    )
                    size, rows, found = 0, [], []

    return rows.mapInArrow(scan, "d_id long, d_tie long, unit int, start int, stop int, words int, digest binary")


def repeated_spans(
    docs: DataFrame, unit: str = "line", min_words: int = 10, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``d_id, d_tie, start, stop, words, units``: the spans to remove, in offsets of the original text.

    The earliest occurrence is that of the smallest id (NULL last), then text hash (``d_tie``), then place in the text; it
    stays. Rows equal in id and text are one document and stay alike. NULL and blank texts have no units. Other columns are
    ignored; no documents give no spans.
    """
    units = unit_rows(docs, unit, id_col, text_col)
    rank = F.struct(F.col("d_id").isNull().alias("last"), "d_id", "d_tie", "unit")
    firsts = units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("final"))
    # written out, so that the join below has two plain exchanges and a digest that is everywhere can be split over tasks
    firsts = cut_lineage(firsts.where("first <> final").select(F.col("digest").alias("known"), "first"))
    repeats = units.join(firsts, F.col("digest") == F.col("known")).where(rank != F.col("first"))
    # islands of neighbouring units
    inside = Window.partitionBy("d_id", "d_tie").orderBy("unit")
    runs = repeats.select("d_id", "d_tie", "unit", "start", "stop", "words").distinct()
    runs = runs.withColumn("run", F.col("unit") - F.row_number().over(inside))
    runs = runs.groupBy("d_id", "d_tie", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.count("*").alias("units"),
    )
    return runs.where(F.col("words") >= min_words).drop("run")


def remove_repeats(
    docs: DataFrame, unit: str = "line", min_words: int = 10, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with repeats cut out of the text, and ``removed_spans``: ``[start, stop]`` in the original text."""
    spans = repeated_spans(docs, unit, min_words, id_col, text_col)
    per_doc = spans.groupBy(F.col("d_id").alias("x_id"), F.col("d_tie").alias("x_tie")).agg(
        F.array_sort(F.collect_list(F.array("start", "stop"))).alias("x_spans"),
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, found):
            if text is None or found is None or not len(found):
                return text
            edges = [0, *np.concatenate([np.asarray(s) for s in found]).tolist(), len(text)]
            return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))

        return pd.Series([one(t, s) for t, s in zip(texts, spans)])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("d_id"), F.xxhash64(text_col).alias("d_tie"))
    joined = rows.join(per_doc, F.col("d_id").eqNullSafe(F.col("x_id")) & (F.col("d_tie") == F.col("x_tie")), "left")
    given = F.col("row")
    return joined.select(
        *[(cut(given[c], "x_spans") if c == text_col else given[c]).alias(c) for c in docs.columns],
        F.coalesce("x_spans", F.array().cast("array<array<int>>")).alias("removed_spans"),
    )
