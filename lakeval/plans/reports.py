"""Queries on finished runs: predictions, comparator tables, findings, judge plans, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scorers
from ..operators import evaluate, reports
from .registry import register
from .scoring import words


@register("""SELECT event_id AS id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE props END AS text, event_id % 5 IN (0, 1) AS failed, event_id % 5 <> 1 AND event_id % 5 <> 0 AND event_id % 7 = 0 AS truncated FROM events""")
def predictions(spark, t):
    """Validation rows with their results: missing, failed, cut off."""
    e = t("events")
    results = e.filter("event_id % 5 <> 0").select(F.col("event_id").alias("custom_id"), F.col("props").alias("text"), F.expr("case when event_id % 5 = 1 then 'failed' end").alias("error"), F.expr("case when event_id % 7 = 0 then 'length' else 'stop' end").alias("finish_reason"))
    return reports.predictions(e.select(F.col("event_id").alias("id")), results)


@register("""SELECT item_id AS id, CASE WHEN item_id % 3 <> 0 THEN 'Better: A' END AS xa, CASE WHEN item_id % 4 <> 0 THEN 'Better: B' END AS ya FROM benchmark""")
def judge_lookup(spark, t):
    """Replies to both orders of a pair by their composed ids."""
    b = t("benchmark")
    one = b.filter("item_id % 3 <> 0").select(F.concat(F.lit("pw:trained:teacher:xa:"), F.col("item_id").cast("string")).alias("custom_id"), F.lit("Better: A").alias("text"))
    two = b.filter("item_id % 4 <> 0").select(F.concat(F.lit("pw:trained:teacher:ya:"), F.col("item_id").cast("string")).alias("custom_id"), F.lit("Better: B").alias("text"))
    return reports.judge_replies(b.select(F.col("item_id").alias("id")), one.unionAll(two), "trained", "teacher")


def _present(spark):
    return spark.createDataFrame([("baseline", None, None), ("untrained", "Small", "org/small"), ("trained", "Small", "org/small"), ("teacher", "Large", "org/large")], "comparator string, model string, repo string")


@register("SELECT * FROM (VALUES ('trained', 'untrained'), ('trained', 'baseline')) v(x, y)")
def judge_plan(spark, t):
    """Pairs to judge where the teacher is the judge, whose own answers it does not judge."""
    return reports.judge_pairs(reports.judged_comparators(_present(spark), "ORG/large"))


@register("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, lower(split_part(coalesce(CASE WHEN a.n_nationkey % 3 = 0 THEN a.n_name || '@v1' END, a.n_name), '@', 1)) = lower(split_part(coalesce(CASE WHEN b.n_nationkey % 2 = 0 THEN lower(b.n_name) || '@v2' END, b.n_name), '@', 1)) AS same
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def same_models(spark, t):
    """Which names are one model, by name or by repository."""
    a, b = t("nation").alias("a"), t("nation").alias("b")
    both = a.join(b, F.expr("a.n_regionkey = b.n_regionkey"))
    same = reports.same_model(F.col("a.n_name"), F.col("b.n_name"), F.expr("case when a.n_nationkey % 3 = 0 then a.n_name || '@v1' end"), F.expr("case when b.n_nationkey % 2 = 0 then lower(b.n_name) || '@v2' end"))
    return both.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), same.alias("same"))


_SCORES = """s AS (SELECT user_id AS run, CASE event_type WHEN 'view' THEN 'trained' WHEN 'click' THEN 'baseline' WHEN 'error' THEN 'teacher' WHEN 'signup' THEN 'other' ELSE 'untrained' END AS comparator, CASE WHEN user_id % 9 <> 0 THEN round(count(*) FILTER (WHERE event_id % 2 = 0) / count(*), 6) END AS score, count(*) AS n FROM events GROUP BY 1, 2)"""


def _scores(t):
    comparator = F.expr("case event_type when 'view' then 'trained' when 'click' then 'baseline' when 'error' then 'teacher' when 'signup' then 'other' else 'untrained' end")
    e = t("events").select(F.col("user_id").alias("run"), comparator.alias("comparator"), (F.col("event_id") % 2 == 0).alias("even"))
    s = e.groupBy("run", "comparator").agg(F.round(F.count_if("even") / F.count("*"), 6).alias("s"), F.count("*").alias("n"))
    return s.select("run", "comparator", F.when(F.col("run") % 9 != 0, F.col("s")).alias("score"), "n")


@register(f"WITH {_SCORES} SELECT run, comparator, score, n, CAST(CASE comparator WHEN 'baseline' THEN 1 WHEN 'untrained' THEN 2 WHEN 'trained' THEN 3 ELSE 4 END AS BIGINT) AS place FROM s WHERE comparator <> 'other'")
def comparator_table(spark, t):
    """Scores by comparator with their place in the table."""
    return reports.comparator_table(_scores(t))


@register(f"""WITH {_SCORES}, j AS (SELECT o.run, o.comparator, x.score - o.score AS gap, o.n FROM s o JOIN s x ON x.run = o.run AND x.comparator = 'trained' AND x.score IS NOT NULL WHERE o.comparator IN ('baseline', 'untrained', 'teacher') AND o.score IS NOT NULL)
SELECT run, comparator, round(abs(gap), 3) AS difference, CAST(round_even(abs(gap) * n, 0) AS BIGINT) AS "rows", CASE WHEN gap > 0 THEN 'trained' WHEN gap < 0 THEN comparator ELSE 'same' END AS leader FROM j""")
def findings(spark, t):
    """How far the trained model is ahead or behind, in score and in rows."""
    return reports.findings(_scores(t), whole_rows=True)


@register("SELECT user_id AS run, count(*) AS uses FROM events WHERE event_type = 'purchase' GROUP BY 1")
def test_uses(spark, t):
    """How often a run was scored on the final test."""
    records = t("events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"))
    return reports.test_uses(records)


@register("SELECT p_partkey AS job, round(CASE WHEN p_size % 7 > 0 THEN p_retailprice / (p_size % 7) ELSE 0 END, 6) AS tokens_per_sec, round(CASE WHEN p_size > 3 THEN (p_size % 7)::DOUBLE / (p_size - 3) * (100 - (p_size - 3)) END, 6) AS eta_seconds FROM part")
def throughputs(spark, t):
    """Tokens a second and seconds left of jobs."""
    jobs = t("part").select(F.col("p_partkey").alias("job"), F.greatest(F.lit(0), F.col("p_size") - 3).alias("done"), F.lit(100).alias("total"), F.col("p_retailprice").alias("tokens"), (F.col("p_size") % 7).alias("elapsed"))
    return reports.throughput(jobs).select("job", "tokens_per_sec", "eta_seconds")


@register("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_id % 3 = 0) AS teacher_rows, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE event_id % 3 = 0) AS tokenizers, CAST(coalesce(min(CASE WHEN event_id % 3 = 0 THEN 2 + event_id % 4 END), 0) AS INTEGER) AS k FROM events""")
def teacher_scan(spark, t):
    """What training rows say about their teacher."""
    top = F.when(F.col("event_id") % 3 == 0, F.array(F.sequence(F.lit(1), (F.col("event_id") % 4 + 2).cast("int"))))
    return reports.teacher_scan(t("events").select(F.col("event_type").alias("tokenizer"), top.alias("top_ids")))


@register("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'none' WHEN event_type = 'view' THEN 'aligned' ELSE 'text' END AS teacher FROM events WHERE event_id % 5 <> 0 AND event_id % 6 <> 0""")
def teacher_lines(spark, t):
    """Which distillation records keep their teacher's tokens."""
    ids = F.array(F.lit(1), F.lit(2))
    rows = t("events").select("event_id", F.expr("case when event_id % 5 = 0 then 'failed' end").alias("error"), F.expr("case when event_id % 6 = 0 then ' ' else props end").alias("completion"), F.col("event_type").alias("tokenizer"), ids.alias("token_ids"), F.when(F.col("event_id") % 4 == 0, F.slice(ids, 1, 1)).otherwise(ids).alias("logprobs"))
    return reports.teacher_lines(rows, "view").select("event_id", "teacher")


@register("""SELECT c_custkey AS run, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'e' || c_custkey ELSE c_custkey || '/original' END AS evaluation, c_custkey % 3 IN (0, 1) AS explicit, NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 1) AS found FROM customer""")
def chosen_evaluations(spark, t):
    """The evaluation that stands for each run."""
    c = t("customer").select(F.col("c_custkey").alias("run"))
    evals = c.select("run", F.concat(F.lit("e"), F.col("run").cast("string")).alias("evaluation"), F.when(F.col("run") % 2 == 0, "completed").otherwise("failed").alias("status"))
    use = c.filter("run % 3 in (0, 1)").select("run", F.when(F.col("run") % 3 == 0, F.concat(F.lit("e"), F.col("run").cast("string"))).otherwise(F.concat(F.col("run").cast("string"), F.lit("/original"))).alias("evaluation"))
    return reports.chosen_evaluation(c, evals, use)


@register("""WITH r AS (SELECT o_orderkey AS run, o_orderpriority AS model, nullif(o_orderstatus, 'O') AS quant, o_custkey % 10 AS input, o_orderkey % 4 <> 0 AS ok FROM orders), w AS (SELECT DISTINCT model, quant, input FROM r WHERE input < 5 UNION ALL SELECT 'none', NULL, 0)
SELECT w.model, w.quant, w.input, max(run) AS run FROM w LEFT JOIN r ON r.model = w.model AND r.quant IS NOT DISTINCT FROM w.quant AND r.input = w.input AND ok GROUP BY ALL""")
def cached_runs(spark, t):
    """The newest finished run of a model, quantisation and input."""
    r = t("orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("model"), F.nullif("o_orderstatus", F.lit("O")).alias("quant"), (F.col("o_custkey") % 10).alias("input"), F.lit("completed").alias("status"), F.lit(5).alias("rows"), F.when(F.col("o_orderkey") % 4 == 0, 4).otherwise(5).alias("rows_done"))
    wanted = r.filter("input < 5").select("model", "quant", "input").distinct().unionByName(r.limit(1).select(F.lit("none").alias("model"), F.lit(None).cast("string").alias("quant"), F.lit(0).cast("long").alias("input")))
    return reports.cached_run(r, wanted, ["model", "quant", "input"])


@register(f"WITH {_SCORES} SELECT run, comparator, score AS original, CASE WHEN run % 4 <> 0 THEN round(score / 2, 6) END AS new, round(CASE WHEN run % 4 <> 0 THEN round(score / 2, 6) END - score, 6) AS difference FROM s")
def score_changes(spark, t):
    """Original and new scores of a second evaluation."""
    old = _scores(t)
    return reports.score_changes(old, old.withColumn("score", F.when(F.col("run") % 4 != 0, F.round(F.col("score") / 2, 6)))).select("run", "comparator", "original", "new", "difference")


@register("""WITH x AS (SELECT a.vec_id AS id, (a.vec_id % 11) / 10.0::DOUBLE AS was, CASE WHEN a.vec_id % 13 = 0 THEN 0 ELSE (a.vec_id % 7) / 10.0::DOUBLE END AS now FROM embeddings a)
SELECT id, CASE WHEN now > was THEN 'improvement' ELSE 'regression' END AS change FROM x WHERE abs(now - was) >= 0.25""")
def open_differences(spark, t):
    """Open answers whose word overlap is a quarter apart or more."""
    e = t("embeddings").select(F.col("vec_id").alias("id"))
    return reports.open_differences(e.withColumn("f1", (F.col("id") % 11) / 10.0), e.withColumn("f1", F.when(F.col("id") % 13 != 0, (F.col("id") % 7) / 10.0)))


@register("""WITH e AS (SELECT vec_id AS id, range(0, 4 + vec_id % 3) AS p, list_transform(range(0, 4 + vec_id % 2), lambda i: CASE WHEN vec_id % 5 = 0 AND i = 2 THEN 99 ELSE i END) AS q FROM embeddings),
m AS (SELECT id, p, q, CASE WHEN id % 5 = 0 THEN 2 ELSE least(len(p), len(q)) END AS met FROM e)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE p = q AND id % 4 <> 0) AS identical, CAST(sum(met) AS BIGINT) AS tokens, round(max((met - 1) / 100.0::DOUBLE), 6) AS largest_gap FROM m""")
def greedy_comparison(spark, t):
    """Two engines' tokens up to where they part."""
    e = t("embeddings").select(F.col("vec_id").alias("id"))
    side = lambda last, token, lp: F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(token(i).alias("token"), lp(i).alias("logprob")))
    a = e.select("id", F.lit("t").alias("text"), side(F.col("id") % 3 + 3, lambda i: i, lambda i: -i.cast("double")).alias("tokens"))
    b = e.select("id", F.when(F.col("id") % 4 == 0, "u").otherwise("t").alias("text"), side(F.col("id") % 2 + 3, lambda i: F.when((F.col("id") % 5 == 0) & (i == 2), F.lit(99).cast("long")).otherwise(i), lambda i: -i.cast("double") - i / 100.0).alias("tokens"))
    return reports.greedy_comparison(a, b)


@register("""WITH a AS (SELECT event_id AS step, value AS x, value * (1 + (event_id % 7) / 1000.0::DOUBLE) AS r, value * (1 + (event_id % 5) / 1000.0::DOUBLE) AS o FROM events WHERE event_id > 50), g AS (SELECT avg(abs(r - x) / greatest(abs(x), 1e-12)) AS r, avg(abs(o - x) / greatest(abs(x), 1e-12)) AS o FROM a)
SELECT round(r, 9) AS resumed, round(o, 9) AS clean, round(1.5 * o + 0.01, 9) AS "limit", r <= 1.5 * o + 0.01 AS pass FROM g""")
def noise_check(spark, t):
    """Whether a resumed loss curve is within the noise of clean runs."""
    e = t("events")
    curve = lambda n: e.select(F.col("event_id").alias("step"), (F.col("value") * (1 + (F.col("event_id") % n) / 1000.0)).alias("loss"))
    return reports.noise_check(curve(7), curve(1), curve(5), 50)


@register("""SELECT c_nationkey AS "group", count(*) AS runs, concat_ws(',', CASE WHEN count(DISTINCT coalesce(c_mktsegment, '')) > 1 THEN 'engine' END, CASE WHEN count(DISTINCT c_nationkey % 4) > 1 THEN 'dtype' END) AS differ, CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN 'cross-runtime' ELSE 'common evaluator' END AS label FROM customer GROUP BY 1 HAVING count(*) > 1""")
def condition_labels(spark, t):
    """What comparable runs ran under, and whether it is the same."""
    runs = t("customer").select(F.col("c_nationkey").alias("group"), F.col("c_mktsegment").alias("engine"), (F.col("c_nationkey") % 4).alias("dtype"))
    return reports.condition_label(runs, "group", ["engine", "dtype"])


@register("SELECT * FROM (VALUES ('baseline', 0.5, 3.5, CAST(10 AS BIGINT), CAST(1 AS BIGINT)), ('teacher', 0.9, NULL, 0, 0), ('trained', 0.8, NULL, NULL, NULL)) v(comparator, score, judge_mean, judge_rows, judge_unscored)")
def judge_metrics(spark, t):
    """A judge's scores beside the others, with the comparator that it must not judge."""
    m = spark.createDataFrame([("baseline", 0.5), ("teacher", 0.9), ("trained", 0.8)], "comparator string, score double")
    j = spark.createDataFrame([("baseline", 3.5, 10, 1, False), ("teacher", None, None, None, True)], "comparator string, judge_mean double, judge_rows long, judge_unscored long, excluded boolean")
    return reports.with_judge_metrics(m, j)


@register("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), p AS (SELECT user_id AS stage, string_agg(event_type, ' -> ' ORDER BY first) AS engines FROM f GROUP BY 1)
SELECT stage, engines, CASE WHEN stage % 2 = 0 THEN stage / 100.0::DOUBLE END AS score, CASE WHEN stage % 2 = 0 AND stage % 3 <> 0 THEN stage / 50.0::DOUBLE END AS reference FROM p""")
def build_table(spark, t):
    """Stages with their engines and their score beside a reference's."""
    rows = t("events").groupBy(F.col("user_id").alias("stage"), "event_type").agg(F.min("event_id").alias("at"))
    stages = rows.groupBy("stage").agg(F.collect_list(F.struct("at", F.col("event_type").alias("engine"))).alias("producers"))
    stages = stages.withColumn("kind", F.when(F.col("stage") % 2 == 0, "eval").otherwise("tune")).withColumn("score", F.col("stage") / 100.0)
    reference = stages.filter("stage % 3 <> 0").select("stage", "kind", (F.col("stage") / 50.0).alias("score"))
    return reports.build_table(stages, reference)


@register("""WITH l AS (SELECT DISTINCT l_orderkey AS plan, l_linenumber AS stage FROM lineitem), s AS (SELECT plan, stage, CASE stage % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'interrupted' END AS old, plan % 3 = 0 OR (plan % 3 = 2 AND min(stage) OVER (PARTITION BY plan) > 1) AS same FROM l)
SELECT plan, stage, CASE WHEN NOT same OR old = 'running' THEN 'pending' ELSE old END AS status, same AND old IN ('running', 'interrupted') AS resumed FROM s""")
def carried_stages(spark, t):
    """Stages carried over from an earlier attempt of the same plan."""
    l = t("lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("stage")).distinct()
    plan = l.withColumn("has", F.lit(1)).withColumn("student", F.lit(None).cast("string"))
    state = plan.withColumn("status", F.expr("case stage % 3 when 0 then 'running' when 1 then 'done' else 'interrupted' end"))
    state = state.withColumn("student", F.when(F.col("plan") % 3 == 1, "other")).filter("plan % 3 <> 2 or stage <> 1")
    return reports.carried_stages(plan, state, ["student"])


@register("""WITH x AS (SELECT event_id, event_id % 3 AS m, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE 1.0 END AS s FROM events) SELECT count(*) AS n_rows, count(*) FILTER (WHERE m = 2) AS differ, round(count(*) FILTER (WHERE m = 2) / count(*), 6) AS rate, round(avg(s), 6) AS source, round(avg(CASE WHEN m = 2 THEN 0.5 ELSE s END), 6) AS artifact, round(avg(CASE WHEN m = 2 THEN 0.5 ELSE s END) - avg(s), 6) AS delta FROM x""")
def export_check(spark, t):
    """An exported model's answers against the saved ones."""
    e = t("events").select(F.col("event_id").alias("id"), F.col("props").alias("text"), F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(1.0).alias("score"))
    other = e.select("id", F.expr("case id % 3 when 1 then '  ' || text || ' ' when 2 then text || 'x' else text end").alias("text"), F.when(F.col("id") % 3 == 2, 0.5).otherwise(F.col("score")).alias("score"))
    return reports.export_check(e, other)


@register("SELECT n_nationkey, n_name || CASE n_nationkey % 3 WHEN 0 THEN '@rev' WHEN 1 THEN '+adapter' ELSE '' END AS model, n_name IN ('FRANCE', 'CHINA', 'BRAZIL') AS approved FROM nation")
def approved_models(spark, t):
    """Models that a list allows."""
    models = t("nation").select("n_nationkey", F.concat("n_name", F.expr("case n_nationkey % 3 when 0 then '@rev' when 1 then '+adapter' else '' end")).alias("model"))
    return reports.approved(models, ["FRANCE", "CHINA", "BRAZIL"])


@register("""WITH r AS (SELECT event_type AS engine, user_id AS model, 'tune' AS kind, event_id % 6 AS units, value AS seconds, event_id AS measured FROM events)
SELECT engine, model, kind, arg_max(round(seconds / units, 9), measured) AS seconds_per_unit FROM r WHERE units > 0 AND seconds > 0 GROUP BY ALL""")
def stage_rates(spark, t):
    """The newest measured rate of each engine, model and stage."""
    return reports.latest_rates(t("events").select(F.col("event_type").alias("engine"), F.col("user_id").alias("model"), F.lit("tune").alias("kind"), (F.col("event_id") % 6).alias("units"), F.col("value").alias("seconds"), F.col("event_id").alias("measured")))


@register("SELECT o_orderkey AS job FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 10 < 9 AND o_orderkey % 2 = 1")
def interrupted_jobs(spark, t):
    """Jobs that stopped in the middle."""
    jobs = t("orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), (F.col("o_orderkey") % 10).alias("done"), F.lit(9).alias("total"), (F.col("o_orderkey") % 2 == 0).alias("alive"))
    return reports.interrupted_jobs(jobs).select("job")


@register("""SELECT vec_id, CASE WHEN n <= 6 THEN n END AS n_ids, CASE WHEN n <= 6 THEN 2 + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1 END END AS trained, CASE WHEN n > 6 THEN 'too long' END AS problem FROM (SELECT vec_id, 1 + vec_id % 5 + 2 + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1 END AS n FROM embeddings)""")
def teacher_examples(spark, t):
    """Examples of a teacher's own tokens, ended where it did not end."""
    prompt = F.sequence(F.lit(0).cast("long"), F.col("vec_id") % 5)
    tokens = F.array(F.lit(7).cast("long"), F.when(F.col("vec_id") % 2 == 0, 1).otherwise(8).cast("long"))
    ids, mask, problem = reports.teacher_example(prompt, tokens, F.array(F.lit(2), F.lit(1)).cast("array<bigint>"), 6)
    return t("embeddings").select("vec_id", F.when(ids.isNotNull(), F.size(ids)).alias("n_ids"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("trained"), problem.alias("problem"))


@register(f"""WITH p AS (SELECT a.conv_id, CASE WHEN a.conv_id % 6 = 0 THEN NULL ELSE {words('a.text')} END AS x, {words('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT count(*) AS n_rows, round(avg(CASE WHEN x IS NULL THEN 0 WHEN x = y THEN 1.0 ELSE 0 END), 9) AS exact_match, round(avg(CASE WHEN x IS NULL THEN 0 ELSE len(x) END), 9) AS output_words, round(avg(len(y)), 9) AS reference_words, count(*) FILTER (WHERE x IS NULL) AS failed FROM p""")
def open_summary(spark, t):
    """Exact matches and lengths of open answers, failed ones included."""
    from .scoring import _turns

    text = F.when(F.col("conv_id") % 6 != 0, F.col("q"))
    x, y = scorers.words(text), scorers.words(F.col("a"))
    rows = _turns(t).select(text.isNull().alias("failed"), scorers.token_f1(text, F.col("a")).alias("f1"), scorers.rouge_l(text, F.col("a")).alias("rouge"), (x == y).alias("exact"), F.size(x).alias("output_words"), F.size(y).alias("reference_words"))
    return reports.open_metrics(rows).select("n_rows", "exact_match", "output_words", "reference_words", "failed")


@register()
def open_overlap(spark, t):
    """Mean word overlap and ROUGE-L of open answers, failed ones as 0."""
    from .scoring import _turns

    text = F.when(F.col("conv_id") % 6 != 0, F.col("q"))
    x, y = scorers.words(text), scorers.words(F.col("a"))
    rows = _turns(t).select(text.isNull().alias("failed"), scorers.token_f1(text, F.col("a")).alias("f1"), scorers.rouge_l(text, F.col("a")).alias("rouge"), (x == y).alias("exact"), F.size(x).alias("output_words"), F.size(y).alias("reference_words"))
    return reports.open_metrics(rows)


@register("""SELECT l_returnflag AS pair, count(*) AS n_rows, count(*) FILTER (WHERE l_linenumber <> 4) AS scored, round(count(*) FILTER (WHERE l_linenumber = 1) / count(*) FILTER (WHERE l_linenumber <> 4), 9) AS win_rate, round(count(*) FILTER (WHERE l_linenumber NOT IN (1, 2, 4)) / count(*) FILTER (WHERE l_linenumber <> 4), 9) AS tie_rate, round(count(*) FILTER (WHERE l_linenumber = 2) / count(*) FILTER (WHERE l_linenumber <> 4), 9) AS loss_rate FROM lineitem GROUP BY 1""")
def pairwise_rates(spark, t):
    """Rates of wins, ties and losses over scored rows."""
    verdict = F.expr("case l_linenumber when 1 then 'x' when 2 then 'y' when 4 then null else 'tie' end")
    return evaluate.pairwise_rates(t("lineitem").select(F.col("l_returnflag").alias("pair"), verdict.alias("verdict")), "pair", "x", "y")


@register("""SELECT event_type AS engine, user_id % 3 AS host, event_id % 2 AS os, value > 50 AS fast, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL""")
def producers(spark, t):
    """Rows by every field of their producer."""
    e = t("events").select(F.col("event_type").alias("engine"), (F.col("user_id") % 3).alias("host"), (F.col("event_id") % 2).alias("os"), (F.col("value") > 50).alias("fast"), "event_id")
    return e.groupBy("engine", "host", "os", "fast").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@register("SELECT o_orderkey AS run FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def last_runs(spark, t):
    """The ten newest runs."""
    return t("orders").select(F.col("o_orderkey").alias("run")).orderBy(F.desc("run")).limit(10)


@register("SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 12")
def longest_first(spark, t):
    """The head of a queue that takes long rows first."""
    return t("documents").select("doc_id", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(12)


@register("""WITH i AS (SELECT doc_id % 5 AS file, doc_id AS row FROM documents WHERE doc_id % 3 = 0) SELECT file, row FROM i QUALIFY row_number() OVER (PARTITION BY file ORDER BY row) <= 8""")
def capped_issues(spark, t):
    """The first eight issues of each file."""
    from ..operators.rows import ranked_head

    return ranked_head(t("documents").filter("doc_id % 3 = 0").select((F.col("doc_id") % 5).alias("file"), F.col("doc_id").alias("row")), ["file"], ["row"], 8)


@register("""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS text, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END AS score FROM events""")
def scored_results(spark, t):
    """Results by id against what was expected; no score for an error or where nothing was expected."""
    choice = F.struct(F.struct(F.col("event_type").alias("content")).alias("message"))
    body = F.struct(F.struct(F.array(choice).alias("choices")).alias("body"))
    row = F.struct(F.expr("case when event_id % 5 = 0 then 'failed' end").alias("error"), body.alias("response"))
    results = t("events").select(F.col("event_id").alias("id"), scorers.response_text(row).alias("text"))
    expected = t("events").filter("event_id % 7 <> 0").select(F.col("event_id").alias("id"), F.lit("view").alias("expected"))
    score = F.when(F.col("expected").isNotNull(), scorers.exact_match(F.col("text"), F.array("expected")))
    return evaluate.scored(results, expected, "id", score).select("id", "text", "score")


@register("""WITH r AS (SELECT event_type AS kind, user_id AS id, event_id, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS status FROM events)
SELECT kind, CAST(id AS VARCHAR) AS id, arg_max(status, event_id) AS status FROM r GROUP BY ALL""")
def run_listing(spark, t):
    """The newest version of each record, written in two steps."""
    from ..operators.records import Records
    from ..workspace import Workspace

    records = Records(spark, f"{Workspace(spark, 'records').base}/table")
    rows = t("events").select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("id"), F.expr("case event_id % 3 when 0 then 'running' when 1 then 'completed' else 'failed' end").alias("status"), F.timestamp_seconds("event_id").alias("at"), F.col("props").alias("body"), "event_id")
    records.write(rows.filter("event_id % 2 = 0"))
    records.write(rows.filter("event_id % 2 = 1"))
    return records.listing().select("kind", "id", "status")


@register("""SELECT c_custkey AS run, sha256('{"segment":"' || c_mktsegment || '","seed":' || (c_custkey % 3) || ',"judge":' || CASE WHEN c_custkey % 2 = 0 THEN 'null' ELSE '"j"' END || '}') AS identity FROM customer""")
def run_identities(spark, t):
    """A digest of what each run's identity covers."""
    from ..operators.records import identity

    rows = t("customer").select(F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 3).alias("seed"), F.when(F.col("c_custkey") % 2 == 1, "j").alias("judge"))
    return rows.select("run", identity(["segment", "seed", "judge"]).alias("identity"))


@register("""WITH c(tag, b) AS (VALUES ('small', 0.5), ('mid', 1.5), ('large', 7.0), ('huge', 32.0)), m AS (SELECT s_suppkey AS k, (1 + s_suppkey % 90) * 1e9 AS mem, CASE s_suppkey % 3 WHEN 0 THEN 'LARGE' WHEN 1 THEN 'mid' ELSE 'small' END AS student FROM supplier)
SELECT k, coalesce(arg_max(tag, b) FILTER (WHERE b >= 1.5 AND tag <> lower(student) AND b * 2e9 <= 0.6 * mem), 'mid') AS judge FROM m, c GROUP BY k""")
def recommended_judges(spark, t):
    """The largest judge that fits each machine's memory, other than the student; else the smallest."""
    from ..functions import planning

    k = F.col("s_suppkey")
    m = t("supplier").select(k.alias("k"), ((1 + k % 90) * F.lit(1e9)).alias("memory"), F.expr("case s_suppkey % 3 when 0 then 'LARGE' when 1 then 'mid' else 'small' end").alias("student"))
    return planning.recommended(m, [("small", 0.5), ("mid", 1.5), ("large", 7.0), ("huge", 32.0)]).select("k", "judge")


@register("""WITH r AS (SELECT event_type AS model, CASE WHEN user_id % 2 = 0 THEN 'bf16' END AS quant, user_id % 3 AS adapter, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value) % 2 END AS score, value AS latency, length(props) AS tokens FROM events)
SELECT model, quant, adapter, count(*) AS n_rows, round(avg(score), 9) AS mean_score, count(*) FILTER (WHERE score IS NULL) AS unscored, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, sum(tokens) AS tokens FROM r GROUP BY model, quant, adapter""")
def eval_by_model(spark, t):
    """The evaluation table by model, quantisation and adapter."""
    score = F.when(F.col("event_id") % 7 != 0, F.round("value") % 2)
    runs = t("events").select(F.col("event_type").alias("model"), F.when(F.col("user_id") % 2 == 0, "bf16").alias("quant"), (F.col("user_id") % 3).alias("adapter"), score.alias("score"), F.col("value").alias("latency"), F.length("props").alias("tokens"))
    return evaluate.eval_table(runs, ("model", "quant", "adapter"))


@register("""WITH x AS (SELECT o_orderkey AS k, o_custkey % 10 AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'p' ELSE 'q' END AS b FROM orders),
l AS (SELECT k, 'r.a' AS path, CAST(a AS VARCHAR) AS was, CAST(CASE WHEN k % 2 = 0 THEN a ELSE a + 1 END AS VARCHAR) AS now FROM x UNION ALL SELECT k, 'r.list.0', '"' || b || '"', '"p"' FROM x UNION ALL SELECT k, 'r.list.1', 'null', CASE WHEN k % 5 = 0 THEN 'null' END FROM x UNION ALL SELECT k, 'e', '{}', '[]' FROM x)
SELECT k, path, was, now FROM l WHERE was IS DISTINCT FROM now""")
def json_diff(spark, t):
    """Paths on which two JSON trees differ."""
    from ..functions.jsontools import flat_json
    from ..operators import compare

    o = t("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 10).alias("a"))
    was = F.expr("'{\"r\": {\"a\": ' || a || ', \"list\": [\"' || case when k % 3 = 0 then 'p' else 'q' end || '\", null]}, \"e\": {}}'")
    now = F.expr("'{\"e\": [], \"r\": {\"list\": [\"p\"' || case when k % 5 = 0 then ', null' else '' end || '], \"a\": ' || case when k % 2 = 0 then a else a + 1 end || '}}'")
    side = lambda c: o.select("k", F.explode(flat_json(c)).alias("path", "value"))
    return compare.structural_diff(side(was), side(now), ["k"])


@register("""WITH r AS (SELECT doc_id, lang, sha256('s2' || doc_id) AS h FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS n FROM r), s AS (SELECT count(DISTINCT coalesce(lang, '-')) AS strata FROM r)
SELECT doc_id, lang FROM k, s ORDER BY CASE WHEN n <= 50 // strata THEN 0 ELSE 1 END, h, doc_id LIMIT 50""")
def sample_with_remainder(spark, t):
    """Fifty documents, as even by language as can be."""
    from ..operators.rows import stratified_total

    return stratified_total(t("documents").select("doc_id", "lang"), "lang", "doc_id", "s2", 50)


@register("""WITH e AS (SELECT vec_id, 3 + vec_id % 40 AS n FROM embeddings), w AS (SELECT vec_id, n, CAST(ceil((n - 1) / 32.0) * 32 AS BIGINT) AS width FROM e)
SELECT vec_id, width, width AS n_inputs, CAST((n - 1) * (n - 2) // 2 AS BIGINT) AS inputs, CAST(n * (n - 1) // 2 AS BIGINT) AS targets, CAST(n - 2 AS BIGINT) AS trained FROM w""")
def padded_batches(spark, t):
    """Examples with shifted targets, padded to a multiple of 32."""
    from ..operators import chat

    n = F.col("vec_id") % 40 + 3
    ids = F.sequence(F.lit(0).cast("long"), n - 1)
    mask = F.transform(ids, lambda i: F.when(i < 2, 0).otherwise(1).cast("long"))
    width = (F.ceil((n - 1) / 32) * 32).cast("long")
    inputs, targets, trained = chat.padded_batch(ids, mask, width)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return t("embeddings").select("vec_id", width.alias("width"), F.size(inputs).alias("n_inputs"), total(inputs).alias("inputs"), total(targets).alias("targets"), total(trained).alias("trained"))


@register("""SELECT event_type AS engine, count(*) AS n, count(DISTINCT event_id % 300) AS ids, count(*) - count(DISTINCT event_id % 300) AS repeated FROM events GROUP BY 1""")
def audit_by_engine(spark, t):
    """Rows, ids and repeats of each engine."""
    return evaluate.engine_counts(t("events").select(F.col("event_type").alias("engine"), (F.col("event_id") % 300).alias("id")), "engine", "id")
