"""All documents mixed to weights 5, 2, 1 repeating by source."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...workspace import Workspace
from .. import mixing

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0


def weight_of(sources: list[str | None]) -> list[float]:
    return list(itertools.islice(itertools.cycle(WEIGHTS), len(sources)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = mixing.count_words(docs).drop("text")
    mixed = mixing.mix(sized, Workspace(spark, "op3"), weight_of, CAP)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
