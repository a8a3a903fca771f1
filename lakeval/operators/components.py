"""Connected components of an edge table, by alternating large-star and small-star rounds.

A round is two group-by-minimum joins, so a hub's edges are never gathered in one task: minima are summed
up before the shuffle and the joins are ones that adaptive execution can split. Each round is written to
the workspace; labels settle after a number of rounds that grows with the logarithm of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).head()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns a, b; any ordered type of whole numbers).

    The component is the smallest node that can be reached. Nulls and loops link nothing; repeated edges
    count once; an empty table gives an empty one."""
    links = ws.save(edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(links)
    while state[0]:
        new = ws.save(_small(_large(links).distinct()).distinct(), "edges")
        after = _state(new)
        ws.drop(links)
        links, before, state = new, state, after
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
