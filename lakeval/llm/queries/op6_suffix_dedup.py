"""Bytes of every whole document that a 50-byte string of an earlier document covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...workspace import Workspace
from .. import substrings

WINDOW = 50


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substrings.remove_repeats(docs, Workspace(spark, "op6"), WINDOW)
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
