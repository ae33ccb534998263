"""From raw documents to packed sequences: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.mixing import mixed_documents
from canvass.llm.packing import pack_documents
from canvass.llm.quality import kept_documents
from canvass.llm.secret_scan import redact_secrets
from canvass.llm.similarity_join import distinct_documents
from canvass.llm.storage import documents, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows of texts that a task hands to Python at once.  Spark's 10,000 are some 33 MB of the check tool's texts, which each
#: task then holds several times: as Arrow vectors and as bytes to send outside the heap, and in its Python worker.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """For this session, as stages are read lazily; a smaller number that is already set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    _small_batches(spark)
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    _small_batches(spark)
    return distinct_documents(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    _small_batches(spark)
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target weights: rows are taken as often as the mix says."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    _small_batches(spark)
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the forest, hashed permutations or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
