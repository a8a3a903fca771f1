"""Groups of documents whose sets of three-word shingles are at least nine tenths alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ...workspace import Workspace
from .. import jaccard

WORDS, P, Q = 3, 90, 100


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard.join(docs, Workspace(spark, "op4"), WORDS, P, Q)
