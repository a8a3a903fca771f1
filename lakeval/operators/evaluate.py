"""Joins of results to what was expected, and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored(results: DataFrame, expected: DataFrame, on: str, score: Column) -> DataFrame:
    """Every result with its score; null where nothing was expected."""
    return results.join(expected, on, "left").withColumn("score", score)


def eval_table(runs: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """One row a run, or for each value of ``by`` (model, quant, adapter): rows, mean score over the scored, unscored rows, exact p50 and p95 of latency, tokens.

    Percentiles interpolate linearly over all rows; they are exact, so a run's latencies are grouped by
    value before they are merged."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("score"), 9).alias("mean_score"),
        F.count_if(F.col("score").isNull()).alias("unscored"),
        F.round(F.percentile("latency", F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile("latency", F.lit(0.95)), 6).alias("p95"),
        F.sum("tokens").alias("tokens"),
    )


def class_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy over all rows and macro F1 over the classes of gold, from gold, pred (null: invalid) and
    failed. An invalid prediction is a miss of its gold class and no false positive of any."""
    hits = rows.groupBy(F.col("gold").alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("gold")).alias("tp"))
    called = rows.filter("pred is not null").groupBy(F.col("pred").alias("class")).agg(F.count("*").alias("called"))
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("n") + F.coalesce("called", F.lit(0)))).otherwise(0.0)
    macro = hits.join(called, "class", "left").agg(F.round(F.avg(f1), 9).alias("macro_f1"), F.count("*").alias("classes"))
    whole = rows.agg(F.count("*").alias("n_rows"), F.round(F.avg((F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))).cast("double")), 9).alias("accuracy"), F.count_if(F.col("pred").isNull() & ~F.col("failed")).alias("invalid"), F.count_if("failed").alias("failed"))
    return whole.crossJoin(macro)


def disagreements(runs: DataFrame, models: list[str]) -> DataFrame:
    """Ids that models score differently, or else answer differently; a model without the row counts as
    one with a null."""
    ids = runs.select("id").distinct()
    grid = ids.crossJoin(F.broadcast(ids.sparkSession.createDataFrame([(m,) for m in models], "model string")))
    full = grid.join(runs, ["id", "model"], "left")
    per = full.groupBy("id").agg(F.count_distinct(F.struct("score")).alias("scores"), F.count_distinct(F.struct("text")).alias("texts"), F.count("score").alias("present"))
    return per.filter("scores > 1 or texts > 1").select("id", F.when(F.col("scores") > 1, "score").otherwise("text").alias("by"), "present")


def run_differences(base: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both whose correctness differs: improvement or regression of the other."""
    both = base.select("id", F.col("correct").alias("was")).join(other.select("id", F.col("correct").alias("now")), "id")
    return both.filter("was != now").select("id", F.when(F.col("now"), "improvement").otherwise("regression").alias("change"))


def pairwise_summary(rows: DataFrame, pair: str) -> DataFrame:
    """Wins, ties and losses over scored rows, order disagreement, and how often position A was picked
    among all picks."""
    rate = lambda a, b: F.round(F.when(b > 0, a / b), 9)
    scored_rows = F.count("verdict")
    picks = F.count("pick_1") + F.count("pick_2")
    firsts = F.count_if(F.col("pick_1") == "A") + F.count_if(F.col("pick_2") == "A")
    return rows.groupBy(pair).agg(
        F.count_if(F.col("verdict") == F.col("first")).alias("wins"),
        F.count_if(F.col("verdict") == "tie").alias("ties"),
        F.count_if(F.col("verdict") == F.col("second")).alias("losses"),
        F.count_if(F.col("verdict").isNull()).alias("unscored"),
        rate(F.count_if("disagreed"), scored_rows).alias("disagreement"),
        rate(firsts, picks).alias("first_pick_rate"),
    )


def pointwise_summary(rows: DataFrame, by: str) -> DataFrame:
    """Mean over the scored, unscored rows, and how many of each score from 1 to 5."""
    return rows.groupBy(by).agg(F.round(F.avg("score"), 9).alias("mean"), F.count_if(F.col("score").isNull()).alias("unscored"), *(F.count_if(F.col("score") == s).alias(f"s{s}") for s in range(1, 6)))


def calibration(rows: DataFrame) -> DataFrame:
    """Judge's 4 or 5 against a word-for-word match, over scored rows with a short reference."""
    high, match = F.col("score") >= 4, F.col("match")
    some = rows.filter("checkable and score is not null")
    cells = some.agg(F.count_if(high & match).alias("both"), F.count_if(high & ~match).alias("judge_only"), F.count_if(~high & match).alias("match_only"), F.count_if(~high & ~match).alias("neither"), F.count("*").alias("n"))
    return cells.withColumn("agreement", F.round(F.when(F.col("n") > 0, (F.col("both") + F.col("neither")) / F.col("n")), 9))


def row_audit(wanted: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, extra or there more than once."""
    counts = results.groupBy(key).agg(F.count("*").alias("n"))
    whole = wanted.select(key).distinct().withColumn("wanted_", F.lit(True)).join(counts, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted_").isNull(), "extra").when(F.col("n") > 1, "duplicated")
    return whole.select(key, F.coalesce("n", F.lit(0)).alias("n"), problem.alias("problem")).filter("problem is not null")


def islands(rows: DataFrame, order: str, by: str, within: list[str]) -> DataFrame:
    """Ranges of adjacent rows of one ``by``, within the given keys: start, end, rows."""
    w = Window.partitionBy(*within).orderBy(order)
    change = F.coalesce((F.col(by) != F.lag(by).over(w)).cast("int"), F.lit(0))
    marked = rows.withColumn("c_", change).withColumn("i_", F.sum("c_").over(w))
    return marked.groupBy(*within, by, "i_").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("i_")


def sequence_score(rows: DataFrame, by: str, lp: str) -> DataFrame:
    """Sum, mean and perplexity of the log-probabilities of the tokens that stand there."""
    out = rows.groupBy(by).agg(F.count("*").alias("n_target"), F.sum(lp).alias("t"))
    mean = F.col("t") / F.col("n_target")
    return out.select(by, "n_target", F.round("t", 6).alias("total"), F.round(mean, 6).alias("mean"), F.round(F.exp(-mean), 6).alias("perplexity"))


def pairwise_rates(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Shares of wins, ties and losses among scored rows; null where none is scored."""
    n = F.count("verdict")
    rate = lambda c: F.round(F.when(n > 0, F.count_if(c) / n), 9)
    v = F.col("verdict")
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), n.alias("scored"), rate(v == x).alias("win_rate"), rate(~v.isin(x, y)).alias("tie_rate"), rate(v == y).alias("loss_rate"))


#: The scorer that each task's outputs get.
TASK_SCORERS = {"classification": "class_metrics", "exact": "class_metrics", "json": "json_metrics", "open": "open_metrics"}


def task_metrics(task: str, rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Metrics of scored rows by task; with a column ``script_score`` also its mean."""
    from . import reports

    if task not in TASK_SCORERS:
        raise ValueError(f"no task {task!r}: {', '.join(sorted(TASK_SCORERS))}")
    kind = TASK_SCORERS[task]
    out = class_metrics(rows) if kind == "class_metrics" else reports.json_metrics(rows, names or []) if kind == "json_metrics" else reports.open_metrics(rows)
    if "script_score" in rows.columns:
        out = out.crossJoin(rows.agg(F.round(F.avg("script_score"), 9).alias("script_score")))
    return out


def engine_counts(rows: DataFrame, engine: str, key: str) -> DataFrame:
    """Rows of each engine, distinct ids among them and rows beyond the first of an id."""
    each = rows.groupBy(engine, key).agg(F.count("*").alias("n_"))
    return each.groupBy(engine).agg(F.sum("n_").alias("n"), F.count("*").alias("ids"), F.sum(F.col("n_") - 1).alias("repeated"))
