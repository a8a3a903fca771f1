"""Language of every whole document, learned from those that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import hdlang

HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of documents.

    A null doc_id is not held out, and nothing is learned from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", F.expr(HELD_OUT))
    known = hdlang.learn(docs.filter("doc_id is not null and not held_out"))
    return hdlang.predict(docs.select("doc_id", "held_out", "text"), known).drop("text")
