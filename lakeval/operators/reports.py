"""Comparator tables, findings, judge plans and other work on finished runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the order in which comparators are shown.
COMPARATORS = ("baseline", "untrained", "trained", "teacher")
OPEN_GAP = 0.25


def predictions(val: DataFrame, results: DataFrame) -> DataFrame:
    """Validation rows (id, gold) with the text of their result (custom_id, text, error, finish_reason):
    null, and failed, where it is missing or an error; ``truncated`` if it ended for its length."""
    r = results.alias("r")
    good = F.col("r.error").isNull()
    text = F.when(good, F.col("r.text"))
    return val.join(r, F.col("id") == F.col("r.custom_id"), "left").select(*val.columns, text.alias("text"), text.isNull().alias("failed"), F.coalesce(good & (F.col("r.finish_reason") == "length"), F.lit(False)).alias("truncated"))


def judge_replies(items: DataFrame, replies: DataFrame, x: str, y: str) -> DataFrame:
    """Rows (id) with the replies to both orders of a pair, looked up by their composed ids; null where
    there is none. ``replies`` is (custom_id, text)."""
    out = items
    for name in ("xa", "ya"):
        side = replies.select(F.col("custom_id").alias("c_"), F.col("text").alias(name))
        out = out.join(side, F.concat(F.lit(f"pw:{x}:{y}:{name}:"), F.col("id").cast("string")) == F.col("c_"), "left").drop("c_")
    return out


def judged_comparators(present: DataFrame, judge: str) -> DataFrame:
    """(comparator, model, judged): a comparator whose model is the judge is not judged. Names are equal in
    any case; a model's repository counts as its name where ``repo`` has one."""
    same = F.lower(F.trim(F.coalesce("repo", "model"))) == judge.strip().lower()
    tagged = F.lower(F.trim("model")) == judge.strip().lower()
    return present.withColumn("judged", ~F.coalesce(same | tagged, F.lit(False))).select("comparator", "model", "judged")


def same_model(a: Column, b: Column, repo_a: Column, repo_b: Column) -> Column:
    """Whether two model names are the same weights: one name in any case, or one repository without its
    revision. An empty name is no model."""
    bare = lambda c, name: F.lower(F.substring_index(F.coalesce(c, name), "@", 1))
    named = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return named & ((F.lower(F.trim(a)) == F.lower(F.trim(b))) | (bare(repo_a, a) == bare(repo_b, b)))


def judge_pairs(judged: DataFrame) -> DataFrame:
    """(x, y): the trained model against each other judged comparator, if it is judged itself."""
    some = judged.filter("judged").select("comparator")
    left = some.filter("comparator = 'trained'").select(F.col("comparator").alias("x"))
    return left.join(F.broadcast(some.filter(F.col("comparator").isin("untrained", "teacher", "baseline")).select(F.col("comparator").alias("y"))))


def comparator_table(metrics: DataFrame) -> DataFrame:
    """Metrics (run, comparator, ...) with the comparator's place in the fixed order; others are left out."""
    order = F.array(*map(F.lit, COMPARATORS))
    return metrics.withColumn("place", F.array_position(order, F.col("comparator"))).filter("place > 0")


def findings(scores: DataFrame, whole_rows: bool) -> DataFrame:
    """(run, comparator, difference, rows, leader) of the trained model against each other comparator, from
    (run, comparator, score, n). Runs without a trained score have none. ``rows`` is the difference in rows
    where the score counts whole ones, halves to even."""
    trained = scores.filter("comparator = 'trained' and score is not null").select("run", F.col("score").alias("own"))
    others = scores.filter("comparator in ('baseline', 'untrained', 'teacher') and score is not null")
    gap = F.col("own") - F.col("score")
    leader = F.when(gap > 0, F.lit("trained")).when(gap < 0, F.col("comparator")).otherwise("same")
    rows = F.bround(F.abs(gap) * F.col("n")).cast("long") if whole_rows else F.lit(None).cast("long")
    return others.join(trained, "run").select("run", "comparator", F.round(F.abs(gap), 3).alias("difference"), rows.alias("rows"), leader.alias("leader"))


def test_uses(records: DataFrame) -> DataFrame:
    """Completed final-test records of each run."""
    return records.filter("status = 'completed'").groupBy("run").agg(F.count("*").alias("uses"))


def throughput(jobs: DataFrame) -> DataFrame:
    """tokens_per_sec and eta_seconds of jobs (done, total, tokens, elapsed); no estimate before the first row."""
    rate = F.when(F.col("elapsed") > 0, F.col("tokens") / F.col("elapsed")).otherwise(F.lit(0.0))
    eta = F.when(F.col("done") > 0, F.col("elapsed") / F.col("done") * (F.col("total") - F.col("done")))
    return jobs.withColumn("tokens_per_sec", F.round(rate, 6)).withColumn("eta_seconds", F.round(eta, 6))


def teacher_scan(rows: DataFrame) -> DataFrame:
    """Rows, rows with a teacher's top-k, its tokenizers and the least K, from (tokenizer, top_ids)."""
    has = F.size("top_ids") > 0
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(has).alias("teacher_rows"), F.array_join(F.array_sort(F.collect_set(F.when(has, F.col("tokenizer")))), ",").alias("tokenizers"), F.coalesce(F.min(F.when(has, F.size(F.get("top_ids", F.lit(0))))), F.lit(0)).alias("k"))


def teacher_lines(records: DataFrame, student_tokenizer: str) -> DataFrame:
    """Whether each distillation record keeps its teacher's tokens: yes with the student's tokenizer, text
    where it is another, none without log-probabilities for every token. Failed and blank records go."""
    good = records.filter("error is null and coalesce(trim(completion), '') <> ''")
    aligned = (F.coalesce(F.size("logprobs"), F.lit(0)) > 0) & F.size("logprobs").eqNullSafe(F.size("token_ids"))
    kind = F.when(~F.coalesce(aligned, F.lit(False)), "none").when(F.col("tokenizer").eqNullSafe(F.lit(student_tokenizer)), "aligned").otherwise("text")
    return good.withColumn("teacher", kind)


def chosen_evaluation(runs: DataFrame, evaluations: DataFrame, use: DataFrame) -> DataFrame:
    """Each run with its evaluation: its original one, unless ``use`` (run, evaluation) names another
    completed one of it. ``found`` is false where a named one is not there."""
    done = evaluations.filter("status = 'completed'").select("run", "evaluation").distinct().withColumn("there_", F.lit(True))
    wanted = runs.join(use.select("run", F.col("evaluation").alias("named_")), "run", "left")
    original = F.concat(F.col("run").cast("string"), F.lit("/original"))
    both = wanted.join(done.withColumnRenamed("evaluation", "named_"), ["run", "named_"], "left")
    named = F.col("named_").isNotNull() & (F.col("named_") != original)
    return both.select("run", F.when(named & F.col("there_"), F.col("named_")).otherwise(original).alias("evaluation"), F.col("named_").isNotNull().alias("explicit"), (~named | F.col("there_").isNotNull()).alias("found"))


def cached_run(runs: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest completed run of each wanted combination of keys (null equals null) whose rows are all done."""
    a, b = wanted.alias("a"), runs.filter("status = 'completed' and rows_done = rows").alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(b, cond, "left").groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(F.max("b.run").alias("run"))


def score_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Original and new score of each (run, comparator) of ``new``, and their difference to six decimals."""
    was = old.select("run", "comparator", F.col("score").alias("original"))
    return new.select("run", "comparator", F.col("score").alias("new")).join(was, ["run", "comparator"], "left").withColumn("difference", F.round(F.col("new") - F.col("original"), 6))


def open_differences(base: DataFrame, trained: DataFrame, gap: float = OPEN_GAP) -> DataFrame:
    """Rows of both whose word overlap (f1, null counts as 0) is apart by a quarter or more."""
    both = base.select("id", F.coalesce("f1", F.lit(0.0)).alias("was")).join(trained.select("id", F.coalesce("f1", F.lit(0.0)).alias("now")), "id")
    d = F.col("now") - F.col("was")
    return both.filter(F.abs(d) >= gap).select("id", F.when(d > 0, "improvement").otherwise("regression").alias("change"))


def greedy_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two engines' tokens (id, text, tokens array of (token, logprob)): ids, how many are the same, tokens up
    to the first divergence, and the largest gap of log-probability there."""
    x, y = a.alias("x"), b.alias("y")
    n = F.least(F.size("x.tokens"), F.size("y.tokens"))
    both = x.join(y, "id").select("id", F.col("x.text").eqNullSafe(F.col("y.text")).alias("text"), F.transform("x.tokens", lambda t: t["token"]).alias("p"), F.transform("y.tokens", lambda t: t["token"]).alias("q"), F.zip_with(F.slice("x.tokens", 1, n), F.slice("y.tokens", 1, n), lambda s, t: F.struct((s["token"] == t["token"]).alias("same"), F.abs(s["logprob"] - t["logprob"]).alias("gap"))).alias("both"))
    first = F.array_position(F.transform("both", lambda t: t["same"]), F.lit(False))
    met = F.when(first > 0, first - 1).otherwise(F.size("both")).cast("int")
    each = both.select("id", (F.col("text") & (F.col("p") == F.col("q"))).alias("same"), met.alias("met"), F.array_max(F.transform(F.slice("both", 1, met), lambda t: t["gap"])).alias("gap"))
    return each.agg(F.count("*").alias("n_rows"), F.count_if("same").alias("identical"), F.sum("met").alias("tokens"), F.round(F.max("gap"), 6).alias("largest_gap"))


def noise_check(resumed: DataFrame, reference: DataFrame, other: DataFrame, start: int) -> DataFrame:
    """Whether a resumed loss curve (step, loss) is no farther from the reference, after ``start``, than half
    as much again as a clean run elsewhere, and a hundredth."""
    side = lambda df, name: df.filter(F.col("step") > start).select("step", F.col("loss").alias(name))
    both = side(resumed, "r").join(side(reference, "x"), "step").join(side(other, "o"), "step")
    far = lambda c: F.avg(F.abs(F.col(c) - F.col("x")) / F.greatest(F.abs("x"), F.lit(1e-12)))
    out = both.agg(far("r").alias("resumed"), far("o").alias("clean"))
    return out.select(F.round("resumed", 9).alias("resumed"), F.round("clean", 9).alias("clean"), F.round(1.5 * F.col("clean") + 0.01, 9).alias("limit"), (F.col("resumed") <= 1.5 * F.col("clean") + 0.01).alias("pass"))


def condition_label(runs: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """Of each group of comparable runs: ``common evaluator`` where all fields agree (null is a value), else
    ``cross-runtime``, with the fields that differ. Groups of one run are left out."""
    differs = [F.count_distinct(F.struct(f)) > 1 for f in fields]
    names = F.array_join(F.array_compact(F.array(*(F.when(d, f) for d, f in zip(differs, fields, strict=True)))), ",")
    out = runs.groupBy(group).agg(F.count("*").alias("runs"), names.alias("differ"))
    return out.filter("runs > 1").withColumn("label", F.when(F.col("differ") == "", "common evaluator").otherwise("cross-runtime"))


def with_judge_metrics(metrics: DataFrame, judge: DataFrame) -> DataFrame:
    """Comparators' metrics with the judge's mean, rows and unscored rows; a comparator that it left out has
    no mean and no rows, and one that it never saw has nulls."""
    both = metrics.join(judge, "comparator", "left")
    out = F.coalesce(F.col("excluded"), F.lit(False))
    zero = lambda c: F.when(out, F.lit(0).cast("long")).otherwise(F.col(c))
    return both.select(*metrics.columns, F.when(~out, F.col("judge_mean")).alias("judge_mean"), zero("judge_rows").alias("judge_rows"), zero("judge_unscored").alias("judge_unscored"))


def build_table(stages: DataFrame, reference: DataFrame) -> DataFrame:
    """Stages with the chain of their engines in order of first use, and their score beside a reference's."""
    engines = F.array_join(F.array_distinct(F.transform(F.array_sort("producers"), lambda p: F.coalesce(p["engine"], F.lit("?")))), " -> ")
    ref = reference.filter("kind = 'eval'").select("stage", F.col("score").alias("reference"))
    shown = stages.withColumn("engines", F.when(F.size("producers") > 0, engines).otherwise("-"))
    return shown.withColumn("score", F.when(F.col("kind") == "eval", F.col("score"))).join(ref, "stage", "left").select("stage", "engines", "score", "reference")


def carried_stages(plan: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stages of a plan with the status that an earlier attempt left, where the attempt had the very same plan
    (null equals null): running becomes pending; else every stage is pending."""
    a, b = plan.alias("a"), state.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    each = a.join(b, ["plan", "stage"], "full_outer").withColumn("ok_", F.coalesce(F.col("a.has").isNotNull() & F.col("b.has").isNotNull() & same, F.lit(False)))
    whole = Window.partitionBy("plan")
    each = each.withColumn("all_", F.min(F.col("ok_").cast("int")).over(whole) == 1)
    status = F.when(~F.col("all_") | (F.col("b.status") == "running"), "pending").otherwise(F.col("b.status"))
    resumed = F.col("all_") & F.col("b.status").isin("running", "interrupted")
    return each.filter("a.has is not null").select("plan", "stage", status.alias("status"), resumed.alias("resumed"))


def export_check(saved: DataFrame, exported: DataFrame) -> DataFrame:
    """An export's answers (id, text, score) against the saved ones: how many texts differ without white
    space at their ends, both means, and their difference."""
    from ..functions.text import strip

    a, b = saved.select("id", F.col("text").alias("was"), F.col("score").alias("s")), exported.select("id", F.col("text").alias("now"), F.col("score").alias("x"))
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    out = b.join(a, "id", "left").agg(F.count("*").alias("n_rows"), F.count_if(clean("was") != clean("now")).alias("differ"), F.avg("s").alias("source"), F.avg("x").alias("artifact"))
    rate = F.round(F.col("differ") / F.greatest(F.lit(1), F.col("n_rows")), 6)
    return out.select("n_rows", "differ", rate.alias("rate"), F.round("source", 6).alias("source"), F.round("artifact", 6).alias("artifact"), F.round(F.col("artifact") - F.col("source"), 6).alias("delta"))


def open_metrics(rows: DataFrame) -> DataFrame:
    """Means over all rows of (failed, f1, rouge, exact, output_words, reference_words); a failed row counts
    0 in each but the reference's words."""
    zero = lambda c: F.round(F.avg(F.when(F.col("failed"), 0.0).otherwise(F.col(c).cast("double"))), 9)
    return rows.agg(F.count("*").alias("n_rows"), zero("f1").alias("token_f1"), zero("rouge").alias("rouge_l"), zero("exact").alias("exact_match"), zero("output_words").alias("output_words"), F.round(F.avg("reference_words"), 9).alias("reference_words"), F.count_if("failed").alias("failed"))


def json_metrics(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rates over all rows of scored JSON (``s`` as ``json_scorer`` gives it, failed), the accuracy of each
    named field and their mean."""
    mean = lambda c: F.round(F.avg(c.cast("double")), 9)
    field = {n: F.avg(F.coalesce(F.try_element_at("s.fields", F.lit(n)), F.lit(False)).cast("double")) for n in names}
    out = rows.agg(F.count("*").alias("n_rows"), mean(F.col("s.parseable")).alias("parseable"), mean(F.col("s.valid")).alias("valid"), mean(F.col("s.whole")).alias("whole"), F.count_if(F.size("s.extra") > 0).alias("extra"), F.count_if("failed").alias("failed"), *(F.round(c, 9).alias(f"field_{n}") for n, c in field.items()))
    total = sum((F.col(f"field_{n}") for n in names), F.lit(0.0))
    return out.withColumn("mean_field", F.round(total / len(names), 9) if names else F.lit(None).cast("double"))


def approved(models: DataFrame, allowed: Sequence[str] | None) -> DataFrame:
    """Models with whether they may be used: their name before any ``@`` and ``+`` is on the list, or there is
    no list."""
    base = F.substring_index(F.substring_index("model", "@", 1), "+", 1)
    ok = F.lit(True) if allowed is None else base.isin(*allowed)
    return models.withColumn("approved", ok)


def latest_rates(rows: DataFrame) -> DataFrame:
    """Seconds a unit of each (engine, model, kind), from its newest measurement with any units."""
    good = rows.filter("units > 0 and seconds > 0")
    return good.groupBy("engine", "model", "kind").agg(F.max_by(F.round(F.col("seconds") / F.col("units"), 9), "measured").alias("seconds_per_unit"))


def interrupted_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that were running and have rows left, whose owner is gone."""
    return jobs.filter("status = 'running' and done < total and not alive")


def teacher_example(prompt: Column, tokens: Column, eos: Column, most: int) -> tuple[Column, Column, Column]:
    """(ids, mask, problem) of a prompt's ids and a teacher's own tokens: the answer is trained on, and an
    end token that the teacher left out is added. Longer than ``most``, the example is skipped, never cut."""
    ended = F.array_contains(eos, F.try_element_at(tokens, F.lit(-1)))
    tail = F.when(ended, tokens).otherwise(F.concat(tokens, F.array(F.array_min(eos))))
    ids = F.concat(prompt, tail)
    mask = F.concat(F.transform(prompt, lambda _: F.lit(0)), F.transform(tail, lambda _: F.lit(1)))
    fits = F.size(ids) <= most
    return F.when(fits, ids), F.when(fits, mask), F.when(~fits, "too long")
