"""Byte-level BPE of every whole document, there and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bpe

RANKS = "byte_bpe_50k.tiktoken"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row of documents."""
    path = public_tokenizers.path(RANKS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
