"""Row scorers, run comparison and judge summaries, over answers derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logits, scorers
from ..operators import evaluate
from .examples import norm
from .registry import register

_WORDS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+')"


def words(c: str) -> str:
    return _WORDS.format(norm(c))


_ANSWERS = """a AS (SELECT event_id AS id, event_type AS gold, CASE event_id % 5 WHEN 0 THEN '  ' || upper(event_type) || ' ' WHEN 1 THEN 'click' WHEN 2 THEN event_type WHEN 3 THEN 'none of these' ELSE NULL END AS text FROM events)"""


def _answers(t):
    text = F.expr("case event_id % 5 when 0 then '  ' || upper(event_type) || ' ' when 1 then 'click' when 2 then event_type when 3 then 'none of these' end")
    return t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("gold"), text.alias("text"))


@register(f"WITH {_ANSWERS} SELECT id, CASE WHEN text IS NULL THEN NULL WHEN trim(text) = gold OR trim(text) = 'click' THEN 1.0 ELSE 0.0 END AS score FROM a")
def exact_match(spark, t):
    """The answer is one of the options."""
    return _answers(t).select("id", scorers.exact_match(F.col("text"), F.array("gold", F.lit("click"))).alias("score"))


@register("SELECT doc_id, CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'and') THEN 1.0 ELSE 0.0 END AS score FROM documents WHERE text IS NOT NULL")
def contains_metric(spark, t):
    """All needles are in the text."""
    return t("documents").filter("text is not null").select("doc_id", scorers.contains_all(F.col("text"), F.array(F.lit("The"), F.lit("AND"))).alias("score"))


@register("SELECT doc_id, CASE WHEN regexp_matches(text, '\\d{3}\\) 555-\\d{4}|token = \"[0-9a-f]+\"') THEN 1.0 ELSE 0.0 END AS score FROM documents WHERE text IS NOT NULL")
def regex_metric(spark, t):
    """The pattern is found."""
    pattern = F.lit(r'\d{3}\) 555-\d{4}|token = "[0-9a-f]+"')
    return t("documents").filter("text is not null").select("doc_id", scorers.regex_found(F.col("text"), pattern).alias("score"))


@register("""WITH a AS (SELECT event_id, event_id % 6 AS m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN m = 3 THEN NULL WHEN m IN (4, 5) THEN 0.0 WHEN k = event_id % 100 THEN 1.0 ELSE 0.0 END AS score FROM a""")
def json_field(spark, t):
    """Fields of loosely parsed JSON have the values wanted: 7.0 is 7, "7" is not, and all of them must be right."""
    text = F.expr("case event_id % 6 when 0 then props when 1 then '```json' || chr(10) || replace(props, '}', '.0}') || chr(10) || '```' when 2 then 'It is ' || props || ' then' when 4 then 'nothing' when 5 then replace(replace(props, ': ', ': \"'), '}', '\"}') end")
    wanted = (F.col("event_id") % 100).cast("string")
    expected = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("k="), wanted)).otherwise(F.concat(F.lit('{"k": '), wanted, F.lit("}")))
    return t("events").select("event_id", scorers.json_field(text, expected).alias("score"))


@register(f"""WITH {_ANSWERS}, p AS (SELECT id, gold, text IS NULL AS failed, CASE WHEN {norm('text')} IN ('view','signup','click','error','purchase') THEN {norm('text')} END AS pred FROM a),
h AS (SELECT gold AS c, count(*) AS n, count(*) FILTER (WHERE pred = gold) AS tp FROM p GROUP BY gold), k AS (SELECT pred AS c, count(*) AS called FROM p WHERE pred IS NOT NULL GROUP BY pred),
m AS (SELECT round(avg(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (n + coalesce(called, 0)) ELSE 0 END), 9) AS macro_f1, count(*) AS classes FROM h LEFT JOIN k USING (c))
SELECT count(*) AS n_rows, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) FILTER (WHERE pred IS NULL AND NOT failed) AS invalid, count(*) FILTER (WHERE failed) AS failed, any_value(macro_f1) AS macro_f1, any_value(classes) AS classes FROM p, m""")
def class_metrics(spark, t):
    """Accuracy and macro F1, failed and invalid answers in the denominators."""
    pred, _ = scorers.score_class(F.col("text"), F.col("gold"), ["view", "signup", "click", "error", "purchase"])
    return evaluate.class_metrics(_answers(t).withColumn("pred", pred).withColumn("failed", F.col("text").isNull()))


_RUNS = """r AS (SELECT event_type AS run, event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value) % 2 END AS score, value AS latency, length(props) AS tokens FROM events)"""


def _runs(t):
    score = F.when(F.col("event_id") % 7 != 0, F.round("value") % 2)
    return t("events").select(F.col("event_type").alias("run"), "event_id", "user_id", score.alias("score"), F.col("value").alias("latency"), F.length("props").alias("tokens"))


@register(f"WITH {_RUNS} SELECT run, count(*) AS n_rows, round(avg(score), 9) AS mean_score, count(*) FILTER (WHERE score IS NULL) AS unscored, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, sum(tokens) AS tokens FROM r GROUP BY run")
def eval_table(spark, t):
    """Mean score, unscored rows, latency percentiles and tokens of each run."""
    return evaluate.eval_table(_runs(t))


@register("""WITH r AS (SELECT user_id AS id, event_type AS model, min(CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value) % 2 END) AS score, min(props) AS text FROM events GROUP BY 1, 2),
g AS (SELECT id, model FROM (SELECT DISTINCT id FROM r), (VALUES ('view'), ('click'), ('error')) m(model)),
f AS (SELECT g.id, g.model, score, text FROM g LEFT JOIN r USING (id, model)),
p AS (SELECT id, count(DISTINCT coalesce(CAST(score AS VARCHAR), 'none')) AS s, count(DISTINCT coalesce(text, '')) AS x, count(score) AS present FROM f GROUP BY id)
SELECT id, CASE WHEN s > 1 THEN 'score' ELSE 'text' END AS by, present FROM p WHERE s > 1 OR x > 1""")
def disagreements(spark, t):
    """Rows on which models differ in score, or else in text."""
    score = F.when(F.col("event_id") % 7 != 0, F.round("value") % 2)
    runs = t("events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("model")).agg(F.min(score).alias("score"), F.min("props").alias("text"))
    return evaluate.disagreements(runs, ["view", "click", "error"])


@register("""WITH x AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'view') % 2 = 0 AS was, count(*) FILTER (WHERE event_type = 'click') % 2 = 0 AS now FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'view') > 0 AND count(*) FILTER (WHERE event_type = 'click') > 0)
SELECT id, CASE WHEN now THEN 'improvement' ELSE 'regression' END AS change FROM x WHERE was <> now""")
def model_diff(spark, t):
    """Improvements and regressions between two runs."""
    side = lambda kind: t("events").filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("id")).agg((F.count("*") % 2 == 0).alias("correct"))
    return evaluate.run_differences(side("view"), side("click"))


@register(f"""WITH p AS (SELECT a.conv_id, a.turn, {words('a.text')} AS x, {words('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
o AS (SELECT conv_id, turn, x, y, list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))) AS o FROM p)
SELECT conv_id, turn, round(CASE WHEN len(x) + len(y) > 0 THEN 2.0::DOUBLE * coalesce(o, 0) / (len(x) + len(y)) ELSE 0 END, 9) AS f1, x = y AS same FROM o""")
def token_f1(spark, t):
    """Word overlap of each question with its answer."""
    pairs = _turns(t)
    return pairs.select("conv_id", "turn", F.round(scorers.token_f1(F.col("q"), F.col("a")), 9).alias("f1"), (scorers.words(F.col("q")) == scorers.words(F.col("a"))).alias("same"))


def _turns(t):
    c = t("conversations").select("conv_id", "turn", "role", "text")
    q, a = c.filter("role = 'user'").alias("q"), c.filter("role = 'assistant'").alias("a")
    return q.join(a, F.expr("q.conv_id = a.conv_id and a.turn = q.turn + 1")).select(F.col("q.conv_id").alias("conv_id"), F.col("q.turn").alias("turn"), F.col("q.text").alias("q"), F.col("a.text").alias("a"))


@register()
def rouge_l(spark, t):
    """Longest common word subsequence of each question and its answer, as an F score."""
    return _turns(t).select("conv_id", "turn", F.round(scorers.rouge_l(F.col("q"), F.col("a")), 9).alias("f"))


@register(f"""WITH p AS (SELECT a.conv_id, a.turn, {words('a.text')} AS x, {words('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT count(*) AS n, sum(len(x)) AS output_words, sum(len(y)) AS reference_words, count(*) FILTER (WHERE x = y) AS exact FROM p""")
def open_metrics(spark, t):
    """Lengths and exact matches of open answers."""
    x, y = scorers.words(F.col("q")), scorers.words(F.col("a"))
    return _turns(t).agg(F.count("*").alias("n"), F.sum(F.size(x)).alias("output_words"), F.sum(F.size(y)).alias("reference_words"), F.count_if(x == y).alias("exact"))


_JUDGED = """r AS (SELECT item_id, CASE item_id % 8 WHEN 0 THEN 'Rationale: good.' || chr(10) || 'Score: ' || (item_id % 5 + 1) WHEN 1 THEN 'Score: 2 at first. score = ' || (item_id % 5 + 1) WHEN 2 THEN 'SCORE ' || (item_id % 5 + 1) WHEN 3 THEN 'no idea' WHEN 5 THEN 'Score: **' || (item_id % 5 + 1) || '** of 5' WHEN 6 THEN 'Score: 1' || (item_id % 5 + 1) WHEN 7 THEN 'score-' || (item_id % 9) END AS reply FROM benchmark)"""


@register(f"""WITH {_JUDGED}, s AS (SELECT item_id, TRY_CAST(regexp_extract_all(lower(reply), 'score\\s*[:=-]?\\s*\\**\\s*([1-5])(?:\\D|$)', 1)[-1] AS INTEGER) AS score FROM r)
SELECT item_id % 2 AS model, round(avg(score), 9) AS mean, count(*) FILTER (WHERE score IS NULL) AS unscored, count(*) FILTER (WHERE score = 1) AS s1, count(*) FILTER (WHERE score = 2) AS s2, count(*) FILTER (WHERE score = 3) AS s3, count(*) FILTER (WHERE score = 4) AS s4, count(*) FILTER (WHERE score = 5) AS s5 FROM s GROUP BY 1""")
def pointwise(spark, t):
    """Judge scores from 1 to 5, the last one in a reply."""
    reply = F.expr("CASE" + _JUDGED.split("CASE", 1)[1].rsplit(" AS reply", 1)[0])
    return evaluate.pointwise_summary(t("benchmark").select((F.col("item_id") % 2).alias("model"), scorers.pointwise_score(reply).alias("score")), "model")


@register(f"""WITH {_JUDGED} SELECT item_id, left(trim(CASE WHEN reply IS NULL THEN '' WHEN item_id % 8 = 0 THEN 'good.' ELSE reply END), 600) AS rationale FROM r""")
def rationales(spark, t):
    """The reason a judge gives, or the whole reply."""
    reply = F.expr("CASE" + _JUDGED.split("CASE", 1)[1].rsplit(" AS reply", 1)[0])
    return t("benchmark").select("item_id", scorers.rationale(reply).alias("rationale"))


@register("""SELECT item_id, sha256('You are a strict grader. Reply with one number between 0 and 1 and nothing else.') AS system, sha256('Grade it.' || chr(10) || chr(10) || 'PROMPT:' || chr(10) || '[system] s' || chr(10) || '[user] ' || text || chr(10) || chr(10) || 'EXPECTED:' || chr(10) || item_id || chr(10) || chr(10) || 'RESPONSE:' || chr(10) || CASE WHEN item_id % 3 = 0 THEN '' ELSE 'r' || item_id END || chr(10) || chr(10) || 'Score (0 to 1):') AS user FROM benchmark""")
def judge_prompts(spark, t):
    """The messages that ask a judge for a number."""
    b = t("benchmark")
    prompt = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    response = F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("r"), F.col("item_id").cast("string")))
    m = scorers.judge_messages(F.lit("Grade it."), prompt, F.col("item_id").cast("string"), response)
    return b.select("item_id", F.sha2(m[0]["content"], 256).alias("system"), F.sha2(m[1]["content"], 256).alias("user"))


@register("""WITH p AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'tie' END AS pick_1, CASE item_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' END AS pick_2 FROM benchmark),
m AS (SELECT *, CASE pick_1 WHEN 'A' THEN 'new' WHEN 'B' THEN 'old' WHEN 'tie' THEN 'tie' END AS one, CASE pick_2 WHEN 'A' THEN 'old' WHEN 'B' THEN 'new' END AS two FROM p),
v AS (SELECT *, CASE WHEN one IS NULL OR two IS NULL THEN NULL WHEN one = two THEN one ELSE 'tie' END AS verdict, one <> two AS disagreed FROM m)
SELECT 'new-old' AS pair, count(*) FILTER (WHERE verdict = 'new') AS wins, count(*) FILTER (WHERE verdict = 'tie') AS ties, count(*) FILTER (WHERE verdict = 'old') AS losses, count(*) FILTER (WHERE verdict IS NULL) AS unscored,
round(count(*) FILTER (WHERE disagreed) / nullif(count(verdict), 0), 9) AS disagreement, round((count(*) FILTER (WHERE pick_1 = 'A') + count(*) FILTER (WHERE pick_2 = 'A')) / nullif(count(pick_1) + count(pick_2), 0), 9) AS first_pick_rate FROM v""")
def pairwise(spark, t):
    """Verdicts of both presentation orders, and how often the first place wins."""
    one = F.expr("case item_id % 4 when 0 then 'Better: B. No, better: A' when 1 then 'Better = answer B' when 2 then 'better: **tie**' else 'unsure' end")
    two = F.expr("case item_id % 3 when 0 then 'Better B' when 1 then 'better - ANSWER A' end")
    rows = t("benchmark").select(scorers.pairwise_pick(one).alias("pick_1"), scorers.pairwise_pick(two).alias("pick_2")).withColumns({"first": F.lit("new"), "second": F.lit("old"), "pair": F.lit("new-old")})
    verdict, disagreed = scorers.combined_orders(scorers.to_model(F.col("pick_1"), F.col("first"), F.col("second")), scorers.to_model(F.col("pick_2"), F.col("second"), F.col("first")))
    return evaluate.pairwise_summary(rows.withColumn("verdict", verdict).withColumn("disagreed", disagreed), "pair")


@register("""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'one two three four five six' ELSE 'Not There' END AS reference, 'the ' || event_type || ' came' AS output, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 5 + 1 END AS score FROM events),
c AS (SELECT score >= 4 AS high, event_id % 3 = 0 AS match FROM r WHERE event_id % 3 <> 1 AND score IS NOT NULL)
SELECT count(*) FILTER (WHERE high AND match) AS both, count(*) FILTER (WHERE high AND NOT match) AS judge_only, count(*) FILTER (WHERE NOT high AND match) AS match_only, count(*) FILTER (WHERE NOT high AND NOT match) AS neither, count(*) AS n, round(count(*) FILTER (WHERE high = match) / count(*), 9) AS agreement FROM c""")
def calibration(spark, t):
    """Judge scores against word-for-word matches."""
    reference = F.expr("case event_id % 3 when 0 then event_type when 1 then 'one two three four five six' else 'Not There' end")
    output = F.concat(F.lit("the "), "event_type", F.lit(" came"))
    score = F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 5 + 1)
    return evaluate.calibration(t("events").select(scorers.checkable(reference).alias("checkable"), scorers.reference_in_output(reference, output).alias("match"), score.alias("score")))


_UNIT = """case item_id % 8 when 0 then 'I say 0.' || (10 + item_id % 90) || ' or 0.9' when 1 then '15 of 20: 1.0' when 2 then '0' when 3 then '27 and 3.5' when 4 then 'about 0.5.' when 5 then 'Score .' || (10 + item_id % 90) || ' ok' when 6 then '1.' else '.5' end"""


@register(f"""WITH r AS (SELECT item_id, {_UNIT} AS reply FROM benchmark), w AS (SELECT item_id, unnest(string_split(reply, ' ')) AS w, generate_subscripts(string_split(reply, ' '), 1) AS place FROM r)
SELECT r.item_id, CAST(arg_min(w, place) FILTER (WHERE regexp_full_match(w, '1(\\.0+)?|0(\\.\\d+)?|\\.\\d+')) AS DOUBLE) AS score FROM r JOIN w USING (item_id) GROUP BY r.item_id""")
def judge_unit_score(spark, t):
    """The first number from 0 to 1 in a reply."""
    return t("benchmark").select("item_id", scorers.unit_score(F.expr(_UNIT)).alias("score"))


_LOGITS = """x AS (SELECT vec_id, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS l, generate_subscripts(embedding, 1) - 1 AS tok FROM embeddings WHERE len(embedding) > 0),
z AS (SELECT vec_id, tok, l - (max(l) OVER w + ln(sum(exp(l - m)) OVER w)) AS lp FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS m FROM x) WINDOW w AS (PARTITION BY vec_id))"""


@register(f"WITH {_LOGITS} SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(lp, 9) DESC, tok) AS rank, CAST(tok AS INTEGER) AS token, round(lp, 6) AS logprob FROM z QUALIFY rank <= 5")
def topk_logprobs(spark, t):
    """The five likeliest tokens of each vector of logits."""
    best = logits.top_tokens(F.col("embedding").cast("array<double>"), 5)
    rows = t("embeddings").select("vec_id", F.posexplode(best).alias("r", "p"))
    return rows.select("vec_id", (F.col("r") + 1).alias("rank"), F.col("p.token").alias("token"), F.round("p.logprob", 6).alias("logprob"))


@register(f"""WITH {_LOGITS}, c AS (SELECT vec_id // 8 AS seq, lp FROM z WHERE tok = vec_id % 16)
SELECT seq, count(*) AS n_target, round(sum(lp), 6) AS total, round(avg(lp), 6) AS mean, round(exp(-avg(lp)), 6) AS perplexity FROM c GROUP BY seq""")
def sequence_score(spark, t):
    """Sum, mean and perplexity of the log-probabilities of the tokens that stand in eight positions each."""
    lp = logits.token_logprob(F.col("embedding").cast("array<double>"), (F.col("vec_id") % 16).cast("int"))
    each = t("embeddings").select(F.expr("vec_id div 8").alias("seq"), lp.alias("lp")).filter("lp is not null")
    return evaluate.sequence_score(each, "seq", "lp")


@register("""WITH p AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE len(a.embedding) > 0 AND len(a.embedding) = len(b.embedding))
SELECT vec_id, round(c, 6) AS cosine FROM p""")
def neighbour_cosine(spark, t):
    """Cosine of each vector with the next one."""
    a, b = t("embeddings").alias("a"), t("embeddings").alias("b")
    both = a.join(b, F.expr("b.vec_id = a.vec_id + 1")).filter("size(a.embedding) > 0 and size(a.embedding) = size(b.embedding)")
    return both.select("a.vec_id", F.round(logits.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


@register(f"""WITH {_LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(teacher, 9) DESC, tok) AS k FROM (SELECT s.vec_id, s.tok, s.lp AS student, x.lp AS teacher FROM z s JOIN z x ON x.vec_id = s.vec_id + 1 AND x.tok = s.tok)),
m AS (SELECT vec_id, exp(student) AS q, exp(teacher) AS p FROM r WHERE k <= 4), o AS (SELECT vec_id, greatest(1e-6, 1 - sum(q)) AS q, greatest(1e-6, 1 - sum(p)) AS p FROM m GROUP BY vec_id),
kl AS (SELECT vec_id, sum(p * (ln(p) - ln(q))) AS kl FROM (SELECT * FROM m UNION ALL SELECT * FROM o) GROUP BY vec_id), ce AS (SELECT vec_id, -lp AS ce FROM z WHERE tok = vec_id % 16)
SELECT vec_id, round(ce, 6) AS ce, round(kl, 6) AS kl, round(0.5 * kl + 0.5 * ce, 6) AS mix FROM kl JOIN ce USING (vec_id)""")
def kd_loss(spark, t):
    """Distillation loss of each vector of logits against the four likeliest tokens of the next one."""
    e = t("embeddings").filter("size(embedding) > 0").select("vec_id", F.col("embedding").cast("array<double>").alias("l"))
    top = e.select((F.col("vec_id") - 1).alias("vec_id"), logits.top_tokens(F.col("l"), 4).alias("t"))
    loss = logits.kd_loss(F.col("l"), F.col("t.token"), F.col("t.logprob"), (F.col("vec_id") % 16).cast("int"))
    return e.join(top, "vec_id").select("vec_id", loss.alias("x")).select("vec_id", *(F.round(f"x.{c}", 6).alias(c) for c in ("ce", "kl", "mix")))
