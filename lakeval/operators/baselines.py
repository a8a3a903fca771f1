"""Approaches without a model: task suggestion, nearest answer by TF-IDF, logistic regression."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words
from ..workspace import Workspace, bound_batches


def suggest_task(df: DataFrame, field: str, out: str) -> DataFrame:
    """(field, n, task): json if all outputs are objects, classification if all are brief, 2 to 200 kinds,
    and four fifths of them repeat; else open. Repeats are counted by value before they are summed up."""
    o = F.col(out)
    obj = F.try_parse_json(o).isNotNull() & F.ltrim(o).startswith("{")
    brief = (F.length(o) <= 40) & (F.size(F.split(F.trim(F.regexp_replace(o, r"\s+", " ")), " ")) <= 4) & ~o.rlike(r"[.!?]\s")
    kinds = df.groupBy(field, F.lower(F.trim(o)).alias("k")).agg(F.count("*").alias("n"), F.count_if(obj).alias("objects"), F.count_if(brief).alias("briefs"))
    whole = kinds.groupBy(field).agg(F.sum("n").alias("n"), F.sum("objects").alias("objects"), F.sum("briefs").alias("briefs"), F.count("k").alias("kinds"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("repeated"))
    labels = (F.col("briefs") == F.col("n")) & F.col("kinds").between(2, 200) & (F.coalesce("repeated", F.lit(0)) >= 0.8 * F.col("n"))
    return whole.select(field, "n", F.when(F.col("objects") == F.col("n"), "json").when(F.col("objects") > 0, "open").when(labels, "classification").otherwise("open").alias("task"))


def tfidf_nearest(train: DataFrame, queries: DataFrame, key: str, head: int = 50_000, most: int = 2_000) -> DataFrame:
    """(key, id, similarity): the training row (id, text) nearest to each query by cosine of TF-IDF, ties to
    the least id; a query that shares no word takes the first row at similarity 0. Rows that repeat an id are one.

    idf is ln((1 + n) / (1 + df)) + 1. Rows are not shuffled: each is held against ``most`` queries a pass where it
    is read. What workers hold are the queries and the idf of the ``head`` most frequent words; rarer words have an
    idf between that of the last of these and that of a word of one row, which bounds a row's length and so its
    similarities. Rows that may be a query's best by these bounds are then measured exactly. The result does not
    depend on ``head`` or ``most``."""
    ws = Workspace(train.sparkSession, "tfidf")
    bags = train.select("id", words(F.col("text")).alias("ws"))
    often = ws.save(train.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 and id is not null").select("id"), "often")
    if not often.isEmpty():
        merged = bags.join(often, "id", "left_semi").groupBy("id").agg(F.flatten(F.collect_list("ws")).alias("ws"))
        bags = bags.join(often, "id", "left_anti").unionByName(merged)
    n, first = train.agg(F.count_distinct("id"), F.min("id")).head()
    df = bags.select("id", F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count("id").alias("df"))
    idf = ws.save(df.select("w", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), "idf", release=True)
    top = idf.orderBy(F.desc("df"), "w").limit(head).collect()
    least = math.log((1 + n) / (1 + top[-1]["df"])) + 1 if len(top) == head else 1.0
    bounds = {r["w"]: r["idf"] for r in top}, least, math.log((1 + n) / 1) + 1

    q = queries.select(key, F.explode(words(F.col("text"))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("tf"))
    qw = ws.save(q.filter(F.col(key).isNotNull()).join(idf, "w").select(key, "w", (F.col("tf") * F.col("idf")).alias("qx")), "queries")
    qn = qw.groupBy(key).agg(F.sqrt(F.sum(F.col("qx") * F.col("qx"))).alias("ql"))
    passes = -(-qn.count() // most)
    found = [_may_be_nearest(bags, qw.filter(F.pmod(F.xxhash64(key), F.lit(passes)) == k), key, bounds) for k in range(passes)]
    if found:
        met = ws.save(reduce(DataFrame.unionByName, found), "met")
        high = met.groupBy(key).agg(F.max("low").alias("least"))
        met = met.join(high, key).filter(F.col("high") >= F.col("least") - _ROUNDING)
        met = ws.save(met.groupBy(key, "bag").agg(F.min("id").alias("id")).select(key, "id"), "left")
        ids = met.select("id").distinct()
        tf = bags.join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, "id", "left_semi").select("id", F.explode("ws").alias("w")).groupBy("id", "w").agg(F.count("*").alias("tf"))
        tw = ws.save(tf.join(idf, "w").select("id", "w", (F.col("tf") * F.col("idf")).alias("tx")), "words")
        tn = tw.groupBy("id").agg(F.sqrt(F.sum(F.col("tx") * F.col("tx"))).alias("tl"))
        dots = met.join(qw, key).join(tw, ["id", "w"]).groupBy(key, "id").agg(F.sum(F.col("qx") * F.col("tx")).alias("dot"))
        sims = dots.join(qn, key).join(tn, "id").select(key, "id", F.round(F.col("dot") / (F.col("ql") * F.col("tl")), 9).alias("similarity"))
        best = sims.groupBy(key).agg(F.max_by(F.struct("id", "similarity"), F.struct("similarity", -F.col("id"))).alias("b"))
        out = queries.select(key).join(best, key, "left").select(key, F.coalesce("b.id", F.lit(first)).alias("id"), F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"))
    else:
        out = queries.select(key, F.lit(first).cast(train.schema["id"].dataType).alias("id"), F.lit(0.0).alias("similarity"))
    out = ws.save(out, "out", release=True)
    ws.keep(out)
    return out


#: Similarities are compared at nine places; twice a half of the last, and what sums in another order differ by.
_ROUNDING = 1e-8


def _may_be_nearest(bags: DataFrame, qw: DataFrame, key: str, bounds: tuple[dict[str, float], float, float]) -> DataFrame:
    """(key, id, bag, low, high) of rows (id, ws) that may be nearest to a query (key, w, qx): bounds of their
    similarity, and a digest of their words. A task leaves out rows that a former one of its own surely beats."""
    rows = qw.collect()
    keys = sorted({r[key] for r in rows})
    number = {k: i for i, k in enumerate(keys)}
    at: dict[str, tuple[list[int], list[float]]] = {}
    square = np.zeros(len(keys))
    for r in rows:
        i, x = at.setdefault(r["w"], ([], []))
        i.append(number[r[key]])
        x.append(r["qx"])
        square[number[r[key]]] += r["qx"] ** 2
    sent = bags.sparkSession.sparkContext.broadcast((bounds, {w: (np.array(i), np.array(x)) for w, (i, x) in at.items()}, np.sqrt(square)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (idf, least, greatest), postings, length = sent.value
        best = np.zeros(len(length))
        for b in batches:
            out: list[tuple] = []
            for i, ws in zip(b.column("id").to_pylist(), b.column("ws"), strict=True):
                ws = ws.as_py()
                if i is None or not ws:
                    continue
                low = high = 0.0
                dot_low, dot_high = np.zeros(len(length)), np.zeros(len(length))
                for w, tf in Counter(ws).items():
                    x = idf.get(w)
                    s, t = (least, greatest) if x is None else (x, x)
                    low += (tf * s) ** 2
                    high += (tf * t) ** 2
                    if w in postings:
                        of, qx = postings[w]
                        dot_low[of] += qx * (tf * s)
                        dot_high[of] += qx * (tf * t)
                high_sim = dot_high / (length * low**0.5)
                may = np.flatnonzero((dot_high > 0) & (high_sim >= best - _ROUNDING))
                if len(may):
                    low_sim = dot_low / (length * high**0.5)
                    best = np.maximum(best, low_sim)
                    bag = hashlib.md5("\0".join(sorted(ws)).encode()).digest()
                    out.extend((int(k), i, bag, low_sim[k], high_sim[k]) for k in may)
            out = [r for r in out if r[4] >= best[r[0]] - _ROUNDING]
            made = dict(zip(("k", "id", "bag", "low", "high"), zip(*out, strict=True), strict=True)) if out else {}
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made["k"], pa.int64()), pa.array(made["id"], b.schema.field("id").type), pa.array(made["bag"], pa.binary()), pa.array(made["low"], pa.float64()), pa.array(made["high"], pa.float64())], names=list(made))

    bound_batches(bags.sparkSession)
    kind = bags.schema["id"].dataType.simpleString()
    met = bags.select("id", "ws").mapInArrow(run, f"k long, id {kind}, bag binary, low double, high double")
    names = bags.sparkSession.createDataFrame(list(enumerate(keys)), T.StructType([T.StructField("k", T.LongType()), qw.schema[key]]))
    return met.join(F.broadcast(names), "k").select(key, "id", "bag", "low", "high")


def logreg(df: DataFrame, vector: str, label: str, held: Column, c: float = 1.0) -> DataFrame:
    """(n_train, n_test, accuracy) of the model that minimises c * sum of losses + half the squared weights,
    intercept free; rows where ``held`` holds are scored."""
    rows = df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), held.alias("held"))
    train = rows.filter(~F.col("held"))
    n = train.count()
    if not n:
        return df.sparkSession.createDataFrame([(0, 0, None)], "n_train long, n_test long, accuracy double")
    model = LogisticRegression(family="multinomial", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(train)
    scored = model.transform(rows.filter("held"))
    return scored.agg(F.lit(n).cast("long").alias("n_train"), F.count("*").alias("n_test"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def ranked(df: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*by)))
