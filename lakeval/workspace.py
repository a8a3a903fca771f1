"""Intermediate tables in the folder that driver and executors share.

A ``Workspace`` cuts lineage by writing Parquet below ``spark.checkpoint.dir``, so a lost executor costs
a reread, never a recomputation of earlier phases. The setting is read from the session; a folder of our
own is chosen only where it is unset and Spark runs in this one process (tests, a laptop). On a cluster
without the setting the call is refused, as executors would not see such a folder.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The setting above is the session's: one write at a time turns it on and back.
_WRITING = threading.RLock()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or one of our own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return str(current).rstrip("/")
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="lakeval-"))
            spark.sparkContext.setCheckpointDir(_OWN_DIR[0])
        named = _OWN_DIR[0]
    return named.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 512) -> None:
    """At most so many rows in a batch for Python, as texts can be long; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


class Workspace:
    """Named Parquet tables of one operator call. ``drop`` frees those the result no longer reads;
    the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/lakeval/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._live: list[str] = []
        self._children: list[Workspace] = []
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str = "t", release: bool = False) -> DataFrame:
        """Write ``df`` and return it as read back.

        The write's shuffle files go when it ends, as nothing reads them again: the table stands for them.
        ``release`` also has the driver forget what earlier plans left."""
        self._n += 1
        path = f"{self.base}/{name}-{self._n}"
        schema = df.schema
        with _WRITING:
            before = self.spark.conf.get(_CLEANUP, None)
            self.spark.conf.set(_CLEANUP, "true")
            try:
                df.write.mode("overwrite").parquet(path)
            finally:
                if before is None:
                    self.spark.conf.unset(_CLEANUP)
                else:
                    self.spark.conf.set(_CLEANUP, before)
        self._live.append(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._lakeval_path = path
        if release:
            del df
            self.release()
        return out

    def child(self, label: str) -> Workspace:
        """A workspace of its own below this one, for a step that frees its tables by ``keep``."""
        out = Workspace(self.spark, label)
        out.base = f"{self.base}/{label}-{uuid.uuid4().hex[:8]}"
        self._children.append(out)
        return out

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files that no plan refers to any more."""
        gc.collect()
        with contextlib.suppress(Exception):
            self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(getattr(t, "_lakeval_path", None))

    def keep(self, *tables: DataFrame) -> None:
        """Free every table but these, those of children included, once what is left reads no others."""
        while self._children:
            self._children.pop().close()
        kept = {getattr(t, "_lakeval_path", None) for t in tables}
        for path in [p for p in self._live if p not in kept]:
            self._live.remove(path)
            self._delete(path)

    def close(self) -> None:
        with contextlib.suppress(Exception):
            self._delete(self.base)

    def _delete(self, path: str | None) -> None:
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
