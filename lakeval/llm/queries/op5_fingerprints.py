"""Fingerprints of every whole document, of its edited text, and how like its neighbours' they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...workspace import Workspace
from .. import fingerprint


def edited_texts(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, text, head: each text with as much of the next document's as it may need.

    The next document is that of the next larger doc_id, after the last the first; of rows that repeat a
    doc_id, the least text. A row without doc_id has no next document and borrows nothing."""
    known, none = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    after = fingerprint.next_keys(docs, "doc_id", ws)
    need = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    pairs = ws.save(after.join(need, "doc_id").select(F.col("doc_id").alias("before"), F.col("next").alias("doc_id"), (F.col("n") / 2).cast("int").alias("half")), "pairs")
    heads = known.join(pairs, "doc_id").select(F.col("before"), F.expr("left(text, half)").alias("head"), "text")
    heads = heads.groupBy(F.col("before").alias("doc_id")).agg(F.min("head").alias("head"))
    return known.join(heads, "doc_id", "left").unionByName(none.withColumn("head", F.lit("")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The likeness of two exact digests is 1 if they are equal, else 0."""
    ws = Workspace(spark, "op5")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = edited_texts(docs, ws)
    half = (F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - int(length(text) / 2))"), F.coalesce(F.substring(F.col("head"), F.lit(1), half), F.lit("")))
    both = both.select("doc_id", "text", edited.alias("edited"))
    keep = [F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")]
    got = ws.save(fingerprint.fingerprints(both, "doc_id", ["text", "edited"], ws, keep), "fingerprints")
    after = fingerprint.next_keys(got, "doc_id", ws)
    least = got.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text_fp").alias("next_fp"))
    nexts = after.join(least, F.col("next") == least["doc_id"]).select(after["doc_id"].alias("at"), "next_fp")
    like = lambda a, b: F.coalesce((F.col(a) == F.col(b)).cast("double"), F.lit(0.0))
    out = got.join(nexts, F.col("doc_id") == F.col("at"), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("text_fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), like("text_fp", "edited_fp").alias("near_edited"), like("text_fp", "next_fp").alias("near_next"))
