"""The library's shared folder for intermediate tables, and the table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canvass.plans.storage import clear, dropped, shared_folder, stored

__all__ = ["clear", "documents", "dropped", "shared_folder", "stored"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
