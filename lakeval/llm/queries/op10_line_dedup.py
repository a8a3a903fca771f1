"""Every whole document less the lines that nearly repeat an earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ...workspace import Workspace
from .. import linededup

TAU, MIN_CHARS = 2, 30
#: Lines that are not blank take part, under MIN_CHARS with edits in proportion.
LEAST = 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text: one row for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linededup.dedup_lines(docs, Workspace(spark, "op10"), TAU, MIN_CHARS, LEAST).select("doc_id", "n_lines", "n_removed", "text")
