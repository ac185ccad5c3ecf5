"""From raw documents to token files: toxic texts out, one of each near-duplicate group, benchmark passages out, sources
mixed to their weights, token ids written. Every stage reads what the one before it wrote."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookcal.llm import decontamination, mixing, queries, simhash, token_files, toxicity
from brookcal.session import scratch_path

#: Rows that go to a Python worker together. The stages move whole texts, and a worker and its executor hold a few batches each.
BATCH_ROWS = 1_000


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """For the stage whose plan is built next; ``run`` puts the caller's value back."""
    spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the model learns from the labels of what came in."""
    _small_batches(spark)
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"), F.coalesce(queries.fold(5) != 0, F.lit(False)))
    scored = toxicity.score_toxicity(docs, model, keep=tuple(docs.columns)).where("predicted = 0")
    return scored.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within 4 bits stays: the one with the smallest id."""
    _small_batches(spark)
    return simhash.keep_first(docs, queries.DISTANCE, queries.SHINGLE)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; a document that consists mostly of them goes."""
    _small_batches(spark)
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in curriculum order."""
    return mixing.mix(docs)


def with_rank(docs: DataFrame) -> DataFrame:
    """``doc_id, text, rank`` of what was read from files that Spark wrote; ``rank`` counts rows in the order of files."""
    # part numbers have five digits or more
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    docs = docs.select("doc_id", "text", F.struct(F.length(name).alias("n"), name.alias("name")).alias("rank_file"), row.alias("rank_row"))
    files = docs.groupBy("rank_file").agg(F.count("*").alias("n")).orderBy("rank_file").collect()
    base = dict(zip([r["rank_file"]["name"] for r in files], accumulate([0] + [r["n"] for r in files])))
    bases = docs.sparkSession.createDataFrame(list(base.items()), "rank_name string, rank_base long")
    placed = docs.join(F.broadcast(bases), F.col("rank_file.name") == F.col("rank_name"), "left")
    return placed.select("doc_id", "text", (F.col("rank_base") + F.col("rank_row")).alias("rank"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, each document with its place in the curriculum; returns their index."""
    _small_batches(spark)
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(with_rank(docs), path, queries.tokenizer_path(), queries.END_ID, position=F.col("rank"))
    return token_files.read_token_files(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: No SQL: the first stage is a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = queries.table(spark, sf_dir, "documents"), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
