"""Groups of rows that belong together, and splits that never part them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .components import connected_components


def row_components(df: DataFrame, key: str, keys: Sequence[Column], ws: Workspace) -> DataFrame:
    """(key, component): rows linked by an equal value of any of ``keys``, however far.

    Each row is linked to the least row of its value, so a value's rows are a star and never all pairs; a
    null value links nothing."""
    edges = None
    for c in keys:
        rows = df.select(F.col(key).alias("k"), c.alias("v")).filter("v is not null")
        star = rows.join(rows.groupBy("v").agg(F.min("k").alias("m")), "v").filter("k != m").select(F.col("k").alias("a"), F.col("m").alias("b"))
        edges = star if edges is None else edges.unionAll(star)
    found = connected_components(edges, ws)
    return df.select(key).distinct().join(found, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("component"))


def deal(components: DataFrame, seed: str, test: float, val: float) -> DataFrame:
    """(component, split): components in the order of a seeded digest go to test until it has its share of
    rows, then to val, the rest to train. ``components`` has one row for each member.

    The running total is over components, summed in two steps: within ranges of the digest's first two
    digits, and over the 256 ranges."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("component").cast("string")), 256)).withColumn("range", F.left("h", F.lit(2)))
    within = F.sum("size").over(Window.partitionBy("range").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0))
    ranges = sizes.groupBy("range").agg(F.sum("size").alias("n"))
    ranges = ranges.withColumn("base", F.sum("n").over(Window.orderBy("range")) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    placed = sizes.withColumn("upto", within).join(F.broadcast(ranges.drop("n")), "range").withColumn("before", F.col("base") + F.col("upto") - F.col("size"))
    goal_t, goal_v = F.bround(F.col("total") * test), F.bround(F.col("total") * val)
    taken = placed.agg(F.sum(F.when(F.col("before") < goal_t, F.col("size")).otherwise(0)).alias("t"))
    placed = placed.crossJoin(F.broadcast(taken))
    split = F.when(F.col("before") < goal_t, "test").when(F.col("before") - F.col("t") < goal_v, "val").otherwise("train")
    return placed.select("component", "size", split.alias("split"))


def class_coverage(df: DataFrame, label: str, split: str) -> DataFrame:
    """Rows of each class by split, and which of train, val and test lack it."""
    counts = df.groupBy(label).agg(*(F.count_if(F.col(split) == s).alias(f"n_{s}") for s in ("train", "val", "test")))
    lacks = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"n_{s}") == 0, s) for s in ("train", "val", "test")))), ",")
    return counts.withColumn("missing_in", lacks)
