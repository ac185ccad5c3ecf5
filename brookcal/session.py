"""Session helpers: shared scratch space, lineage cuts and one-row lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none (unit tests) gets a fresh local one; on a cluster that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="brookcal-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; never reused between calls."""
    return f"{shared_dir(spark).rstrip('/')}/brookcal/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost no recomputation
    of the upstream plan and both readers of ``df`` see the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def one_row(df: DataFrame, *aggregates: Column) -> Column:
    """The aggregates of ``df`` as a struct-valued scalar subquery.

    Catalyst runs it once and embeds the row as a literal: no join is needed
    to bring a global minimum or total next to every row.
    """
    from pyspark.sql import functions as F

    names = [f"x{i}" for i in range(len(aggregates))]
    return df.agg(*[a.alias(n) for a, n in zip(aggregates, names)]).select(
        F.struct(*names)
    ).scalar()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition on ``keys`` over all shuffle partitions.

    Python tiles are small in bytes but heavy in work; without a fixed number
    adaptive execution would merge them into a few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


#: Rows that one task takes of a table whose size is known.
ROWS_PER_TASK = 1_000_000


def spread_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``spread`` into tasks of about ``ROWS_PER_TASK`` of at most ``rows`` rows, however few the shuffle partitions are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // ROWS_PER_TASK)), *keys)
