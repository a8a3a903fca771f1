"""Resumable row jobs on Structured Streaming.

The source is a folder of files, the sink a folder of Parquet segments named by micro-batch, and the
checkpoint says which files are done. A batch that is run again after a crash overwrites its own segment,
so a row is never in two segments of one batch; ids that come again in later files are left out when
results are read. Work is bound to an identity (model, options): a job does not resume under another one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class IdentityChanged(RuntimeError):
    """The state belongs to a job of another identity."""


class RowJob:
    def __init__(self, spark: SparkSession, source: str, sink: str, state: str, identity: Mapping[str, object], schema: StructType, key: str = "custom_id", files_per_batch: int = 25):
        self.spark, self.source, self.sink, self.state = spark, source, sink, state
        self.schema, self.key, self.files = schema, key, files_per_batch
        self.identity = json.dumps(dict(identity), sort_keys=True)
        self.query = None
        self.stopped = False

    def _guard(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.state}/identity")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            known = self.spark.read.text(f"{self.state}/identity").head()[0]
            if known != self.identity:
                raise IdentityChanged(f"state is of {known}, the job of {self.identity}")
        else:
            self.spark.createDataFrame([(self.identity,)], "value string").coalesce(1).write.text(f"{self.state}/identity")

    def run(self, runner: Callable, schema: str) -> None:
        """Work through the files that are new, then return."""
        self._guard()
        self.stopped = False
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.source)

        def segment(df: DataFrame, batch: int) -> None:
            df.withColumn("batch_", F.lit(batch)).write.mode("overwrite").parquet(f"{self.sink}/seg={batch}")

        self.query = query = rows.mapInPandas(runner, schema).writeStream.foreachBatch(segment).option("checkpointLocation", f"{self.state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception() and not self.stopped:
            raise query.exception()

    def stop(self) -> None:
        """End after the micro-batch that is running is given up: it has no segment that counts, and the next
        run does it again. For a signal handler or another thread."""
        self.stopped = True
        if self.query is not None:
            self.query.stop()

    def progress(self) -> dict | None:
        """Batch number and rows of the last micro-batch of this run; none before the first."""
        last = self.query.lastProgress if self.query is not None else None
        return {"batch": last["batchId"], "rows": last["numInputRows"]} if last else None

    def results(self) -> DataFrame:
        """One row an id, the first that was done; of one batch the least in the order of its columns."""
        rows = self.spark.read.parquet(self.sink)
        rest = [c for c in rows.columns if c not in (self.key, "batch_", "seg")]
        first = F.row_number().over(Window.partitionBy(self.key).orderBy("batch_", *rest))
        return rows.withColumn("r_", first).filter("r_ = 1").drop("r_", "batch_", "seg")

    def remaining(self, rows: DataFrame) -> DataFrame:
        """Rows without a result."""
        return rows.join(self.results().select(self.key), self.key, "left_anti")
