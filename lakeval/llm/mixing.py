"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken ``target / source size`` times. The whole part is certain; the
fractional part is rounded by pivoting: a fractional document exchanges words with smaller ones, in the
direction drawn, until it is wholly in or out, so the words taken stay what they were and each document
keeps its probability. Blocks of a few thousand documents of one source pivot by themselves, the largest
first, and leave their smallest fractional ones; those are pivoted again, 64 blocks at a time, up a
reduction tree, and the last one of a source is rounded by a draw. A source's words thus miss its target by
a few words of its smallest documents, unless one document outweighs all smaller ones of its block together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace

BLOCK_ROWS = 4096
FAN_IN = 64
#: Documents, its smallest, that a block leaves to the next level.
LEFT_OPEN = 16


def count_words(df: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """Add the number of runs of characters other than ASCII white space; a null text has none, and an
    input column of the name is replaced."""
    return df.withColumn(out, F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def targets(sizes: list[float], weights: list[float], cap: float) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size; the excess is shared again by
    weight among those below their caps until none is above."""
    total, limit = float(sum(sizes)), [cap * s for s in sizes]
    got = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = total
    while free:
        w = sum(weights[i] for i in free)
        if w <= 0:
            break
        over = [i for i in free if left * weights[i] / w > limit[i]]
        if not over:
            for i in free:
                got[i] = left * weights[i] / w
            break
        for i in over:
            got[i] = limit[i]
        left = max(0.0, left - sum(limit[i] for i in over))
        gone = set(over)
        free = [i for i in free if i not in gone]
    return got


def _uniforms(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) fixed by id, place and salt."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.arange(len(ids), dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**53


def settle(size: np.ndarray, share: np.ndarray, draw: np.ndarray, keep: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Round ``share`` (in [0, 1]) keeping ``sum(size * share)``; also a mask of those left fractional, and
    the draws with what each used of its own taken out, so that they can be used again.

    From the largest down, each document is paired with all smaller ones together: they give it words, or
    take some, in proportion to what each has to give or to take, in the direction drawn, until it is in or
    out. As a draw is fair, every document keeps its probability. What is left are the ``keep`` smallest, or
    one that all smaller ones together could not settle. The shares of those to come are an affine function
    of what they were, so a pass over the documents is enough."""
    x, fresh = share.astype(np.float64), draw.astype(np.float64)
    odd = (x > 1e-9) & (x < 1 - 1e-9)
    x[~odd] = np.round(x[~odd])
    rest = np.zeros(len(x), bool)
    items = np.flatnonzero(odd)
    items = items[np.argsort(-size[items], kind="stable")]
    s, b, u = size[items].astype(np.float64), x[items], draw[items]
    after_s = np.concatenate([np.cumsum(s[::-1])[::-1][1:], [0.0]]) if len(s) else s
    after_b = np.concatenate([np.cumsum((s * b)[::-1])[::-1][1:], [0.0]]) if len(s) else s
    scale, shift = 1.0, 0.0
    for k, i in enumerate(items.tolist()):
        a = min(1.0, max(0.0, scale * b[k] + shift))
        if len(items) - k <= keep and 1e-9 < a < 1 - 1e-9:
            x[i], rest[i] = a, True
            continue
        if not 1e-9 < a < 1 - 1e-9:
            x[i] = round(a)
            continue
        have = min(after_s[k], max(0.0, scale * after_b[k] + shift * after_s[k]))
        lack = after_s[k] - have
        up, down = min(s[k] * (1 - a), have), min(s[k] * a, lack)
        part = down / (up + down) if up + down > 0 else 1.0
        if u[k] < part:  # the smaller ones give it words
            fresh[i] = u[k] / part
            a += up / s[k]
            f = 1 - up / have if have > 0 else 1.0
            scale, shift = scale * f, shift * f
        else:
            fresh[i] = (u[k] - part) / (1 - part)
            a -= down / s[k]
            f = 1 - down / lack if lack > 0 else 1.0
            scale, shift = scale * f, 1 - f + shift * f
        if 1e-9 < a < 1 - 1e-9:
            x[i], rest[i] = a, True
        else:
            x[i] = round(a)
    return x, rest, fresh


def pivot(size: np.ndarray, share: np.ndarray, draw: np.ndarray, last: bool) -> tuple[np.ndarray, int]:
    """``settle`` down to one document and the place of that one; with ``last`` it is drawn too and the place
    is -1."""
    x, rest, fresh = settle(size, share, draw)
    left = np.flatnonzero(rest)
    if last:
        x[left] = fresh[left] < x[left]
        return x, -1
    return x, int(left[0]) if len(left) else -1


def mix(rows: DataFrame, ws: Workspace, weight_of, cap: float = 3.0, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Copies of each row so that every source's words come to its target.

    ``rows`` has doc_id, source, size (not null, at least 0). ``weight_of(sources)`` gives a weight for
    each of the sources, which come ordered by code point with the null source last. The table of sources
    is held by the driver, as any mixing plan is; documents never are. Returns doc_id, source, size,
    source_size, target, copies. Rows without words get 0 copies. Equal rows may get different copies;
    which of them does makes no difference. The draws depend on doc_id and ``seed`` alone, so reruns agree
    whatever the partitions. A null doc_id is drawn as one id. An empty table gives an empty table. Other
    columns are ignored.
    """
    spark = rows.sparkSession
    rows = ws.save(rows.select("doc_id", "source", F.col("size").cast("long").alias("size")), "sizes")
    stats = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n")).collect()
    stats.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [float(r["size"]) for r in stats]
    goal = targets(sizes, list(weight_of([r["source"] for r in stats])), cap)
    plan = []
    for no, (r, g) in enumerate(zip(stats, goal, strict=True)):
        each = min(cap, g / r["size"]) if r["size"] else 0.0
        whole = math.floor(each + 1e-12)
        plan.append((r["source"], no, int(r["size"]), g, whole, max(0.0, each - whole), max(1, -(-r["n"] // block_rows))))
    spec = spark.createDataFrame(plan, "source_ string, no int, source_size long, target double, whole int, share double, blocks long")
    rows = rows.join(spec, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, t) for n, t in (("source", T.StringType()), ("size", T.LongType()), ("no", T.IntegerType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("whole", T.IntegerType()), ("share", T.DoubleType()), ("block", T.LongType()), ("open", T.BooleanType()))])

    def level(depth: int, last: bool):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("doc_id", "ascending"), ("size", "ascending")])
            ids = t.column("doc_id").fill_null(-1).to_numpy().astype(np.int64)
            order = np.argsort(_uniforms(ids, seed), kind="stable")
            x = np.empty(len(ids))
            draws = _uniforms(ids, seed + 1 + depth)
            size, share = t.column("size").to_numpy()[order], t.column("share").to_numpy()[order]
            rest = np.zeros(len(ids), bool)
            if last:
                x[order] = pivot(size, share, draws[order], True)[0]
            else:
                x[order], rest[order], _ = settle(size, share, draws[order], LEFT_OPEN)
            keep = t.select(["doc_id", "source", "size", "no", "source_size", "target", "whole"])
            return keep.append_column("share", pa.array(x)).append_column("block", t.column("block")).append_column("open", pa.array(rest))

        return run

    depth, widest = 0, max((p[-1] for p in plan), default=1)
    some = rows.filter("size > 0").withColumn("block", F.expr(f"pmod(xxhash64(doc_id, {seed}), blocks)")).drop("blocks")
    done = rows.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).alias("copies"))
    copies = (F.col("whole") + F.round("share").cast("int")).alias("copies")
    while True:
        last = widest <= 1
        out = some.groupBy("no", "block").applyInArrow(level(depth, last), schema)
        out = out if last else ws.save(out, f"level{depth}")
        done = done.unionByName(out.filter("not open").select("doc_id", "source", "size", "source_size", "target", copies))
        if last:
            return done
        some = out.filter("open").drop("open").withColumn("block", F.expr(f"block div {FAN_IN}"))
        widest, depth = -(-widest // FAN_IN), depth + 1


def mixed_rows(docs: DataFrame, ws: Workspace, weight_of, cap: float = 3.0, text: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; its columns are those of ``docs``, whatever their
    names.

    A null text has no words and is never taken. Rows that share doc_id, source and size are dealt their copies in the order of their texts."""
    cols = docs.columns
    sized = count_words(docs, text, "size_")
    sizes = sized.select("doc_id", "source", F.col("size_").alias("size"))
    taken = mix(sizes, ws, weight_of, cap).filter("copies > 0").select(F.col("doc_id").alias("d_"), F.col("source").alias("s_"), F.col("size").alias("z_"), F.col("copies").alias("c_"))
    taken = ws.save(taken, "taken")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        out = docs.join(taken, F.col("doc_id") == F.col("d_"))
    else:
        own = Window.partitionBy("doc_id", "source", "size_").orderBy(text)
        other = Window.partitionBy("d_", "s_", "z_").orderBy(F.desc("c_"))
        out = sized.withColumn("n_", F.row_number().over(own)).join(taken.withColumn("m_", F.row_number().over(other)), F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("source").eqNullSafe(F.col("s_")) & (F.col("size_") == F.col("z_")) & (F.col("n_") == F.col("m_")))
    return out.select(*cols, F.explode(F.array_repeat(F.lit(0), F.col("c_"))).alias("copy_")).select(*cols)
