"""Five nearest rows by cosine for every fiftieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vptree

K = 5
FACTOR = 1.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return vptree.search(rows, rows.filter("vec_id % 50 = 0"), K, FACTOR)
