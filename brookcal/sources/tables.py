"""Columnar sources and sinks: series, dimension tables, observation tables, result listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookcal.functions.names import pad_id

SERIES = T.StructType([
    T.StructField("loc", T.StringType()), T.StructField("day", T.DateType()),
    T.StructField("value", T.DoubleType()), T.StructField("var", T.StringType()),
])
OBSERVATION = T.StructType([
    T.StructField("obsnme", T.StringType()), T.StructField("obsval", T.DoubleType()),
    T.StructField("weight", T.DoubleType()), T.StructField("obgnme", T.StringType()),
    T.StructField("standard_deviation", T.DoubleType()), T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
])


def scan_series(spark: SparkSession, path: str, var: str | None = None) -> DataFrame:
    """Daily series; the variable selects a directory, NaN becomes NULL at the source."""
    df = spark.read.schema(SERIES).parquet(path)
    if var is not None:
        df = df.where(F.col("var") == var)
    return df.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def write_series(df: DataFrame, path: str) -> None:
    """One directory per variable. A variable spreads over its own set of files."""
    df.select("loc", "day", "value", "var").write.mode("overwrite").partitionBy("var").parquet(path)


def scan_dimension(
    spark: SparkSession, path: str, schema: T.StructType | str, padded_ids: dict[str, int] | None = None
) -> DataFrame:
    """Header csv with a fixed schema; text is trimmed and ids get their leading zeros back.

    A byte-order mark sits in the header line, which the fixed schema replaces.
    """
    df = (
        spark.read.schema(schema)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .option("enforceSchema", True).csv(path, header=True)
    )
    for name, dtype in df.dtypes:
        if dtype == "string":
            df = df.withColumn(name, F.trim(name))
        elif dtype == "double":
            df = df.withColumn(name, F.nanvl(name, F.lit(None).cast("double")))
    for name, width in (padded_ids or {}).items():
        df = df.withColumn(name, pad_id(F.col(name), width))
    return df


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_observations(frames: Sequence[DataFrame], path: str) -> None:
    """All groups as one table, a directory per group."""
    stack(frames).write.mode("overwrite").partitionBy("obgnme").parquet(path)


def observation_lines(df: DataFrame) -> DataFrame:
    """``name          value`` text lines."""
    return df.select(F.concat("obsnme", F.lit("          "), F.col("obsval").cast("string")).alias("value"))


def scan_observations(spark: SparkSession, path: str, schema: T.StructType | str = OBSERVATION) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def result_parts(name: Column) -> list[Column]:
    """root, iteration and kind of a ``root.iteration.kind.ext`` file name."""
    part = lambda i: F.regexp_extract(name, r"^(.*?)\.(\d+)\.(.*)\.[^.]+$", i)
    return [part(1).alias("root"), part(2).try_cast("int").alias("iteration"), part(3).alias("kind")]


def list_results(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Result files as ``(folder, file, bytes, root, iteration, kind)``; contents are not read.

    ``pattern`` is a glob over file names. With ``recursive``, files in folders below ``path`` are listed too, a folder for each
    case. A name without iteration has none, and an empty root and kind.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    parts = F.split("path", "/")
    files = reader.load(path).select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), F.col("length").alias("bytes"))
    return files.select("folder", "file", "bytes", *result_parts(F.col("file")))


def in_bundle(file: Column, root: str, iterations: int = 3) -> Column:
    """Whether a file belongs to the bundle of a run: data conflicts, objective, noise, and all of iterations 0 to ``iterations``."""
    rest = F.when(file.startswith(root), F.substring(file, len(root) + 1, 10_000)).otherwise("")
    numbered = [rest.startswith(f".{i}") for i in range(iterations + 1)]
    noise = rest.startswith(".") & F.substring(rest, 2, 10_000).contains("noise")
    return reduce(lambda a, b: a | b, [rest.contains("pdc"), rest.contains("phi"), noise, *numbered])


def parameter_iterations(listing: DataFrame, root: str) -> DataFrame:
    """``(folder, iteration, file)`` of the parameter files of a run: those of its base realization where it has any, else all."""
    pars = listing.where(F.col("file").startswith(root) & F.col("file").endswith(".par"))
    step = F.get(F.split(F.substring("file", len(root) + 1, 10_000), r"\."), F.lit(1)).try_cast("int")
    base = F.lower("file").contains("base")
    any_base = F.max(base).over(Window.partitionBy("folder"))
    return pars.withColumn("_any", any_base).where(base == F.col("_any")).select("folder", step.alias("iteration"), "file").where(F.col("iteration").isNotNull())
