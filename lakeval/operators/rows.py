"""Row ids, conflicts, vocabularies, samples, unions: relational operators over example rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized, row_key


def with_row_ids(df: DataFrame, given: str, wanted: str, order: Sequence[str], parts: int = 64) -> DataFrame:
    """Add ``id``: the row key, with ``-n`` for the n-th repeat in source order.

    The number of a repeat is counted in two steps, within ranges of the first order column and over the
    ranges before, so that the copies of one text are never all in one task."""
    first = order[0]
    keyed = df.withColumn("key_", row_key(F.col(given), F.col(wanted)))
    cuts = df.agg(F.approx_percentile(first, F.array(*(F.lit(k / parts) for k in range(1, parts))), 1000).alias("cuts_")) if dict(df.dtypes)[first] in ("tinyint", "smallint", "int", "bigint", "double", "date", "timestamp") else None
    if cuts is None:
        keyed = keyed.withColumn("range_", F.lit(0))
    else:
        keyed = keyed.crossJoin(F.broadcast(cuts)).withColumn("range_", F.coalesce(F.size(F.filter("cuts_", lambda c: c < F.col(first))), F.lit(0))).drop("cuts_")
    counts = keyed.groupBy("key_", "range_").agg(F.count("*").alias("c_"))
    before = counts.select("key_", "range_", (F.sum("c_").over(Window.partitionBy("key_").orderBy("range_")) - F.col("c_")).alias("before_"))
    n = F.row_number().over(Window.partitionBy("key_", "range_").orderBy(*order)) - 1
    rows = keyed.withColumn("n_", n).join(before, ["key_", "range_"]).withColumn("n_", F.col("n_") + F.col("before_"))
    return rows.withColumn("id", F.when(F.col("n_") == 0, F.col("key_")).otherwise(F.concat("key_", F.lit("-"), F.col("n_").cast("string")))).drop("key_", "n_", "range_", "before_")


def duplicate_groups(df: DataFrame, text: str, key: str) -> DataFrame:
    """Normalised texts that more than one row has: digest, number of rows, first and last row."""
    groups = df.groupBy(F.sha2(normalized(F.col(text)), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    return groups.filter("n > 1")


def conflicting(df: DataFrame, given: Column, wanted: Column, key: str) -> DataFrame:
    """Inputs with more than one output: digest of the input, the outputs in order, the first row."""
    rows = df.select(F.sha2(given, 256).alias("digest"), wanted.alias("out"), F.col(key).alias("k"))
    found = rows.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("out")), "|").alias("outputs"), F.count_distinct("out").alias("n_outputs"), F.min("k").alias("first"))
    return found.filter("n_outputs > 1")


def label_vocabulary(df: DataFrame, label: str) -> DataFrame:
    """One spelling for each normalised label: the most common, ties to the larger string."""
    counts = df.groupBy(normalized(F.col(label)).alias("norm"), F.col(label).alias("spelling")).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("n"), F.desc("spelling")))
    return counts.withColumn("r", best).filter("r = 1").select("norm", "spelling", "n")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("r_ = 1").drop("r_")


def distinct_pool(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row for each normalised text, the one with the least key."""
    return first_by(df.withColumn("norm_", normalized(F.col(text))), ["norm_"], [F.col(key)]).drop("norm_")


def stratified(df: DataFrame, stratum: str, key: str, seed: str, per: int) -> DataFrame:
    """``per`` rows of each stratum, in the order of a seeded digest of the key. A stratum's rows are ranked
    with a limit, so a large one is cut where it is read and not gathered."""
    digest = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    ranked = df.withColumn("digest_", digest).withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy("digest_", key)))
    return ranked.filter(F.col("rank") <= per).drop("digest_")


def training_union(own: DataFrame, weight: float, *others: tuple[str, DataFrame]) -> DataFrame:
    """Own rows ``max(1, round(weight))`` times and the others once, each with its origin."""
    times = max(1, round(weight))
    out = own.withColumn("origin", F.lit("own")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("copy")
    for name, df in others:
        out = out.unionByName(df.withColumn("origin", F.lit(name)))
    return out


def leakage_filter(prompts: DataFrame, held: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """Each prompt with what becomes of it: empty, held (its key is among the held rows), repeat, kept.

    The first prompt of a key is its least by ``order``, summed up before the shuffle; no window gathers the
    copies of a prompt."""
    keyed = prompts.withColumn("key_", normalized(F.col(text)))
    known = held.select(normalized(F.col(text)).alias("key_")).distinct().withColumn("held_", F.lit(True))
    first = keyed.groupBy("key_").agg(F.min(F.struct(*order)).alias("first_"))
    fate = F.when(F.coalesce("key_", F.lit("")) == "", "empty").when(F.col("held_"), "held").when(F.struct(*order) != F.col("first_"), "repeat").otherwise("kept")
    return keyed.join(first, "key_", "left").join(known, "key_", "left").withColumn("fate", fate).drop("key_", "first_", "held_")


def overlaps(df: DataFrame, text: str, split: str, key: str) -> DataFrame:
    """Normalised texts in two splits or more: each pair of splits with the first row of either."""
    sides = df.groupBy(normalized(F.col(text)).alias("norm"), F.col(split).alias("split")).agg(F.min(key).alias("first"))
    a, b = sides.alias("a"), sides.alias("b")
    pairs = a.join(b, F.expr("a.norm = b.norm and a.split < b.split"))
    return pairs.select(F.sha2(F.col("a.norm"), 256).alias("digest"), F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b"), F.col("a.first").alias("first_a"), F.col("b.first").alias("first_b"))


def outside_vocabulary(df: DataFrame, label: str, vocabulary: DataFrame) -> DataFrame:
    """Rows whose normalised label the vocabulary lacks."""
    known = vocabulary.select(normalized(F.col("label")).alias("norm_")).distinct()
    return df.withColumn("norm_", normalized(F.col(label))).join(known, "norm_", "left_anti").drop("norm_")


def ranked_head(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key; tasks cut their own rows before they are gathered."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("r_") <= n).drop("r_")


def stratified_total(df: DataFrame, stratum: str, key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows: first ``n // strata`` of each stratum, then the rest of them all, in the order of a seeded
    digest of the key. Fewer if there are no more."""
    digest = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    ranked = df.withColumn("digest_", digest).withColumn("rank_", F.row_number().over(Window.partitionBy(stratum).orderBy("digest_", key))).filter(F.col("rank_") <= n)
    strata = ranked.agg(F.greatest(F.lit(1), F.count_distinct(F.struct(stratum))).alias("strata_"))
    first = F.when(F.col("rank_") <= F.floor(F.lit(n) / F.col("strata_")), 0).otherwise(1)
    return ranked.crossJoin(F.broadcast(strata)).orderBy(first, "digest_", key).limit(n).drop("digest_", "rank_", "strata_")
