"""Every whole document with surrogates for its personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ...workspace import Workspace
from .. import surrogates

KEY = "corpus-surrogates-1"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_replaced: one row for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return surrogates.replace(docs, Workspace(spark, "op2"), KEY).select("doc_id", "text", "n_replaced")
