"""Documents to token ids in five stages, each writing Parquet that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeval.llm import bpe, hdlang, jaccard, linededup, mixing
from lakeval.llm.queries.op1_byte_bpe import RANKS
from lakeval.llm.queries.op3_mixing import CAP, weight_of
from lakeval.llm.queries.op10_line_dedup import LEAST, MIN_CHARS, TAU
from lakeval.workspace import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's own languages; those without letters, or like none, go."""
    known = hdlang.learn(docs)
    judged = hdlang.predict(docs, known, pred="lang_pred_", score="lang_score_", least=hdlang.fences(docs, known))
    return judged.filter(F.col("lang_pred_") != hdlang.UNKNOWN).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that nearly repeat an earlier one; n_chars follows the text. A null text stays
    null; rows of one doc_id count as one document; see ``linededup.dedup_lines``."""
    out = linededup.dedup_lines(docs, Workspace(spark, "lines"), TAU, MIN_CHARS, LEAST)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8.

    Of rows that repeat a doc_id those with linked or equal texts are one document, as any others are;
    unlike texts of one doc_id all stay, and so do rows without a doc_id."""
    ws = Workspace(spark, "near")
    if docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        # the few that go are told by id, so that the texts of those that stay are not shuffled for it; null ids stay
        groups = jaccard.join(docs, ws, words=5, p=80, q=100)
        gone = ws.save(groups.filter("doc_id != component_id").select("doc_id"), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    else:
        from pyspark.sql import Window

        first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(0)))
        rows = docs.filter("doc_id is not null").withColumn("place_", first).filter("place_ = 1").drop("place_")
        rows = ws.save(rows.withColumn("node_", F.monotonically_increasing_id()), "rows")
        groups = jaccard.join(rows.select(F.col("node_").alias("doc_id"), "text"), ws, words=5, p=80, q=100)
        groups = groups.select(F.col("doc_id").alias("node_"), "component_id").join(rows.select("node_", F.col("doc_id").alias("id_"), F.xxhash64("text").alias("text_")), "node_")
        keep = ws.save(groups.groupBy("component_id").agg(F.min_by("node_", F.struct("id_", "text_", "node_")).alias("node_")).select("node_"), "keep")
        kept = rows.join(keep, "node_", "left_semi")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it leaves out go, null and blank texts among them.
    Rows that repeat are dealt their copies one by one; see ``mixing.mixed_rows``."""
    return mixing.mixed_rows(docs, Workspace(spark, "mix"), weight_of, CAP)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (little-endian unsigned 32-bit), and whether decoding
    the ids gives the text again. A null text has no ids; each row is one of the result, repeated or not."""
    back = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return back.select("doc_id", "lang", "source", "n_tokens", "token_ids", same.alias("restored"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("shingle_join", near_copies),
    ("mixing", mix),
    ("byte_bpe", tokens),
]

#: Language profiles, edit joins and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = ws.save(out, name, release=True) if k < len(STAGES) - 1 else out
    return docs
