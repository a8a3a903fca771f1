"""Run records, events and payloads as tables in a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of an event.
EVENTS = ("start", "step", "row", "checkpoint", "preempted", "done", "error")
RECORD = "kind string, id string, status string, at timestamp, body string"


def identity(fields: Sequence[str]) -> Column:
    """Digest of what a run's identity covers: JSON of all fields, nulls included, in the order given."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


class Records:
    """Records of several kinds (runs, evaluations, tests). Each write appends a version; the newest stands."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame) -> None:
        """Append (kind, id, status, at, body)."""
        rows.select("kind", "id", "status", "at", "body").write.mode("append").partitionBy("kind").parquet(self.path)

    def listing(self, kind: str | None = None) -> DataFrame:
        """The newest version of each record of a kind, or of all; of two at one time the larger status."""
        rows = self.spark.read.schema(RECORD).parquet(self.path)
        rows = rows.filter(F.col("kind") == kind) if kind else rows
        newest = F.max(F.struct("at", "status", "body")).alias("v")
        return rows.groupBy("kind", "id").agg(newest).select("kind", "id", "v.status", "v.at", "v.body")

    def index(self) -> DataFrame:
        """Records of each kind by status."""
        return self.listing().groupBy("kind", "status").agg(F.count("*").alias("n"), F.max("at").alias("last"))


def write_events(rows: DataFrame, path: str) -> None:
    """Append events (event, at, job, data) as JSON lines; an unknown kind of event stops the write."""
    known = F.col("event").isin(*EVENTS)
    checked = rows.withColumn("event", F.when(known, F.col("event")).otherwise(F.raise_error(F.concat(F.lit("no such event: "), F.coalesce("event", F.lit("null"))))))
    checked.select("at", "data", "event", "job").write.mode("append").json(path)


def put_payloads(rows: DataFrame, path: str) -> DataFrame:
    """Write payloads (name, content) once, with their digest, and read them back: (name, sha256, bytes). What
    is there is never overwritten; content that reads back with another digest stops the call."""
    sealed = rows.select("name", "content", F.sha2("content", 256).alias("sha256"))
    sealed.write.mode("errorifexists").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    if back.filter(F.sha2("content", 256) != F.col("sha256")).limit(1).count():
        raise OSError(f"{path} does not read back as it was written")
    return back.select("name", "sha256", F.octet_length("content").cast("long").alias("bytes"))


def gate(problems: DataFrame, deadline_fits: bool | None) -> list[str]:
    """Why a build must not start: its split's problems, and a deadline that it misses. No setting is lowered
    to make it fit; without an estimate the deadline does not stop it."""
    found = [r["problem"] for r in problems.select("problem").distinct().orderBy("problem").limit(100).collect()]
    return found + (["the deadline cannot be met"] if deadline_fits is False else [])
