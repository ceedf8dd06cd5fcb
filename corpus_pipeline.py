"""The corpus pipeline: quality, near-dedup, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's docs. Stages with filters keep every row they do not judge
bad, rows with a null doc_id included; other columns of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, near_dup, packing, pii, quality
from millrace.llm.scratch import Scratch


#: Rows of an Arrow batch. Whole rows go through Python here, some of them long, and an
#: executor holds a few batches at a time.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, min(BATCH_ROWS, int(spark.conf.get(name))))


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in bad."""
    bad = bad.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("bad_id"))
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (3)."""
    _small_batches(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component (2)."""
    _small_batches(spark)
    return _without(docs, near_dup.near_duplicates(docs).where("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate (7)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data spans replaced by their kinds (4)."""
    _small_batches(spark)
    return pii.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids (8)."""
    _small_batches(spark)
    return packing.pack(docs, bpe.default_path())


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Training, hashing and tokenizing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
