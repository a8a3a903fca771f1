"""Structural differences, protocols, rankings, histories and other work on run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def structural_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Paths whose values differ, of flattened documents (keys, path, value); a path that one side lacks
    differs unless the other has a null there."""
    x, y = a.alias("x"), b.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*keys, "path"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    both = x.join(y, cond, "full_outer")
    return both.filter(~F.col("x.value").eqNullSafe(F.col("y.value"))).select(*(F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in [*keys, "path"]), F.col("x.value").alias("was"), F.col("y.value").alias("now"))


def protocol_groups(runs: DataFrame, fields: list[str]) -> DataFrame:
    """Runs with their protocol's digest; only runs of one digest are ever ranked together. The digest is of
    JSON with every field, so no two protocols share one by how their values are written, null included."""
    return runs.withColumn("protocol", F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))


def ranked_within(runs: DataFrame, group: str, score: str, run: str) -> DataFrame:
    """Rank in the group by falling score, runs without a score last."""
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(score), run)))


def last_n(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter(F.col("r_") <= n).drop("r_")


def steps_in_order(df: DataFrame, run: str, step: str) -> DataFrame:
    """Whether each run's steps are 1, 2, ... without a gap or a repeat."""
    return df.groupBy(run).agg(F.count("*").alias("n"), ((F.min(step) == 1) & (F.max(step) == F.count("*")) & (F.count_distinct(step) == F.count("*"))).alias("whole"))


def loss_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest and mean relative difference of two loss curves (step, loss), and where the largest is."""
    both = a.select("step", F.col("loss").alias("x")).join(b.select("step", F.col("loss").alias("y")), "step")
    gap = F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs("x"), F.abs("y"), F.lit(1e-12))
    both = both.withColumn("gap", F.round(gap, 9))
    return both.agg(F.count("*").alias("n"), F.max("gap").alias("worst"), F.round(F.avg("gap"), 9).alias("mean"), F.min_by("step", F.struct(-F.col("gap"), "step")).alias("at"))


def ema(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average at the end of each key's rows, starting from the first value. It is a sum of
    the values by weights that fall with the place from the end, so no task holds a key's rows."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1
    rows = df.join(df.groupBy(F.col(key).alias("k_")).agg(F.count("*").alias("n_")), F.col(key).eqNullSafe(F.col("k_"))).withColumn("i_", back)
    weight = F.pow(F.lit(1 - alpha), F.col("i_")) * F.when(F.col("i_") == F.col("n_") - 1, 1.0).otherwise(alpha)
    return rows.groupBy(key).agg(F.sum(F.col(value) * weight).alias("ema"))


def total_or_null(c: Column) -> Column:
    """The sum, null if any part is."""
    return F.when(F.count("*") == F.count(c), F.sum(c))


def deadline_plan(combos: DataFrame, plan: str, combo: str, deadline: float) -> DataFrame:
    """Combinations (student, teacher, judged, seconds) with whether they fit; recommended is, of those that
    do, the one with the largest student, then teacher, then a judge, then the least time. Where none fits,
    ``closest`` is the shortest. Without an estimate a combination neither fits nor is counted."""
    fits = F.col("seconds") <= deadline
    first = F.struct(F.col("student"), F.col("teacher"), F.col("judged"), -F.col("seconds"), -F.col(combo))
    each = combos.withColumn("fits", fits)
    best = each.groupBy(F.col(plan).alias("p_")).agg(F.max(F.when(F.col("fits"), F.struct(first.alias("o"), F.col(combo).alias("c")))).alias("best"), F.min(F.when(F.col("seconds").isNotNull(), F.struct("seconds", combo))).alias("near"))
    both = each.join(best, F.col(plan) == F.col("p_"))
    return both.select(plan, combo, "fits", F.coalesce(F.col("best.c") == F.col(combo), F.lit(False)).alias("recommended"), F.coalesce(F.col("best").isNull() & (F.col(f"near.{combo}") == F.col(combo)), F.lit(False)).alias("closest"))
