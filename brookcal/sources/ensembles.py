"""Wide result csv files as long tables.

A run writes one column per observation, easily 10^5 of them; a csv reader
would plan one Spark column each. Lines are read as text instead and exploded,
so the plan has the same few columns whatever the width is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookcal.sources.text import number, read_lines

# Columns of the phi history that are not realizations.
PHI_SUMMARY_COLUMNS = ("total_runs", "mean", "standard_deviation", "min", "max")


def scan_wide(spark: SparkSession, path: str, key: str, name: str, drop: Sequence[str] = ()) -> DataFrame:
    """(file, key, name, value): first column is the key, the header gives the names."""
    lines = read_lines(spark, path).where(F.length("value") > 0)
    first = lines.groupBy("file").agg(F.min(F.struct("block", "id", "value")).alias("_h"))
    rows = lines.join(first, "file").where((F.col("block") != F.col("_h.block")) | (F.col("id") != F.col("_h.id")))
    cells = rows.select(
        "file", F.split("_h.value", ",").alias("_names"), F.get(F.split("value", ","), F.lit(0)).alias(key),
        F.posexplode(F.split("value", ",")).alias("_p", "_x")).where(F.col("_p") > 0)
    out = cells.select("file", key, F.trim(F.get("_names", F.col("_p"))).alias(name), number(F.col("_x")).alias("value"))
    return out.where(~F.col(name).isin(*drop)) if drop else out


def scan_ensemble(spark: SparkSession, path: str) -> DataFrame:
    return scan_wide(spark, path, "real", "name").select("real", "name", "value")


def scan_phi_history(spark: SparkSession, path: str) -> DataFrame:
    """(iteration, real, phi) without the summary columns; a realization without a phi stays, with NULL."""
    t = scan_wide(spark, path, "iteration", "real", PHI_SUMMARY_COLUMNS)
    return t.select(F.col("iteration").cast("int").alias("iteration"), "real", F.col("value").alias("phi"))


def scan_conflicts(spark: SparkSession, path: str) -> DataFrame:
    """Names in the first column of a conflict csv."""
    first = F.trim(F.get(F.split("value", ","), F.lit(0)))
    return read_lines(spark, path).where((F.length("value") > 0) & (first != "name")).select(first.alias("name"))


def write_ensemble(ens: DataFrame, path: str) -> None:
    """Long sink; the wide form is only for small sets of names (``to_wide``)."""
    ens.select("real", "name", "value").write.mode("overwrite").parquet(path)
