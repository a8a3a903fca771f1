"""Planning queries: memory, disk, time, roles and deadlines, over parts as machines and orders as jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planning
from ..operators import compare
from .registry import register


@register("""WITH d AS (SELECT p_partkey AS k, p_size AS s FROM part), t AS (SELECT k, CASE k % 6 WHEN 0 THEN s || 'h' WHEN 1 THEN s || ' m' WHEN 2 THEN '1d' || s || 'h' WHEN 3 THEN s || '.5h 15s' WHEN 4 THEN s || 'w' ELSE 'soon' END AS text, CASE k % 6 WHEN 0 THEN s * 3600.0 WHEN 1 THEN s * 60.0 WHEN 2 THEN 86400.0 + s * 3600 WHEN 3 THEN s * 3600.0 + 1815 WHEN 4 THEN s * 604800.0 END AS seconds FROM d)
SELECT k, CAST(nullif(seconds, 0) AS DOUBLE) AS seconds, CASE WHEN seconds < 90 THEN format('{:.0f} s', seconds::DOUBLE) WHEN seconds < 5400 THEN format('{:.0f} min', seconds::DOUBLE / 60) WHEN seconds < 172800 THEN format('{:.1f} h', seconds::DOUBLE / 3600) ELSE format('{:.1f} days', seconds::DOUBLE / 86400) END AS shown FROM t WHERE seconds IS NULL OR seconds > 0""")
def durations(spark, t):
    """Durations parsed and written."""
    p = t("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")).filter("s > 0")
    text = F.expr("case k % 6 when 0 then s || 'h' when 1 then s || ' m' when 2 then '1d' || s || 'h' when 3 then s || '.5h 15s' when 4 then s || 'w' else 'soon' end")
    return p.select("k", planning.parse_duration(text).alias("seconds")).withColumn("shown", planning.format_duration(F.col("seconds")))


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN ts > TIMESTAMP '2024-01-01 12:00:00' THEN epoch(date_trunc('minute', ts)) - epoch(TIMESTAMP '2024-01-01 12:00:00') END WHEN 1 THEN 7200.0 WHEN 2 THEN CASE WHEN date_trunc('day', ts) > TIMESTAMP '2024-01-01 12:00:00' THEN epoch(date_trunc('day', ts)) - epoch(TIMESTAMP '2024-01-01 12:00:00') END END AS seconds FROM events
WHERE event_id % 4 <> 0 OR date_trunc('minute', ts) <> TIMESTAMP '2024-01-01 12:00:00'""")
def deadlines(spark, t):
    """Seconds to deadlines given as timestamps or durations."""
    e = t("events").filter("event_id % 4 <> 0 or date_trunc('minute', ts) <> timestamp'2024-01-01 12:00:00'")
    text = F.expr("case event_id % 4 when 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm\") when 1 then '2h' when 2 then date_format(ts, 'yyyy-MM-dd') else 'never' end")
    return e.select("event_id", planning.parse_deadline(text, F.lit("2024-01-01 12:00:00").cast("timestamp")).alias("seconds"))


_GPU = "4::BIGINT * 1073741824 * (1 + p_partkey % 40)"


@register(f"""WITH m AS (SELECT p_partkey AS k, {_GPU} AS ws, 256::BIGINT * (1 + p_partkey % 16) AS hidden, p_size AS layers, 32000::BIGINT AS vocab, 1::BIGINT * 1024 * 1024 * (1 + p_partkey % 300) AS layer_bytes, 128::BIGINT * (1 + p_partkey % 8) AS seq FROM part),
h AS (SELECT *, 4 * hidden AS inter, greatest(64, 1073741824 // (vocab * 12)) * vocab * 12 AS head FROM m),
f AS (SELECT k, floor(ws * 0.75) AS goal, 3 * layer_bytes + 2 * layer_bytes + 4 * 1000000::BIGINT + head AS fixed, seq * hidden * 2 * layers + seq * (2 * (8 * hidden + 4 * inter) + 4 * (6 * hidden + 3 * inter)) + 2 * seq * hidden * 2 AS one FROM h)
SELECT k, CASE WHEN goal >= fixed AND (goal::BIGINT - fixed) // greatest(1, one) >= 1 THEN least((goal::BIGINT - fixed) // greatest(1, one), 500, 64) END AS micro_batch FROM f""")
def micro_batches(spark, t):
    """Largest micro-batch for each machine."""
    p = t("part").withColumn("x", F.col("p_partkey"))
    hidden = 256 * (1 + F.col("x") % 16)
    layer = 1024 * 1024 * (1 + F.col("x") % 300)
    fit = planning.micro_batch(F.lit(4 << 30).cast("long") * (1 + F.col("x") % 40), hidden, 4 * hidden, F.col("p_size").cast("long"), F.lit(32000).cast("long"), layer, 2 * layer, F.lit(1_000_000).cast("long"), 128 * (1 + F.col("x") % 8), F.lit(500))
    return p.select(F.col("p_partkey").alias("k"), fit.alias("micro_batch"))


@register("""WITH j AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 10 = 0 THEN '4bit' END AS asked, o_orderkey % 2 = 0 AS here, (o_orderkey % 100) * 1e9 AS free, (1 + o_orderkey % 30) * 1e9 AS bytes, o_custkey AS n FROM orders),
s AS (SELECT *, ceil(n / 32.0) * 65 * bytes / 2e9 AS seconds FROM j)
SELECT job, round(seconds, 6) AS seconds, CASE WHEN asked IS NOT NULL THEN asked WHEN (NOT here AND free - bytes < 20 * 1073741824.0) OR seconds > 86400 THEN '8bit' ELSE 'bf16' END AS quant, CASE WHEN asked IS NOT NULL THEN 'explicit' WHEN NOT here AND free - bytes < 20 * 1073741824.0 THEN 'disk' WHEN seconds > 86400 THEN 'time' ELSE 'default' END AS reason FROM s""")
def quant_choices(spark, t):
    """Quantisation of each job, with the reason."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    size = (1 + k % 30) * F.lit(1e9)
    seconds = planning.job_seconds(size, n, F.lit(64), F.lit(32), F.lit(2e9))
    quant, reason = planning.quant_choice(F.when(k % 10 == 0, "4bit"), k % 2 == 0, (k % 100) * F.lit(1e9), size, seconds)
    return t("orders").select(k.alias("job"), F.round(seconds, 6).alias("seconds"), quant.alias("quant"), reason.alias("reason"))


@register("""WITH m AS (SELECT p_partkey AS k, (1 + p_partkey % 80) * 1e9 AS w, 1 + p_size AS layers, 131072.0::DOUBLE AS kv, 1024 * (1 + p_partkey % 4) AS ctx, floor((8 + p_partkey % 40) * 1e9 * 0.9) AS budget FROM part),
n AS (SELECT *, CASE WHEN w <= 0.75 * budget THEN layers + 1 ELSE greatest(1, floor(0.75 * budget / (w / layers))) END AS ngl FROM m)
SELECT k, CAST(ngl AS BIGINT) AS layers, CAST(least(256, greatest(1, floor((budget - CASE WHEN w <= 0.75 * budget THEN w ELSE floor(ngl * (w / layers)) END) / (kv * ctx)))) AS BIGINT) AS slots FROM n""")
def offloads(spark, t):
    """Layers and slots on each device."""
    k = F.col("p_partkey")
    layers, slots = planning.offload((1 + k % 80) * F.lit(1e9), 1 + F.col("p_size"), F.lit(131072.0), 1024 * (1 + k % 4), (8 + k % 40) * F.lit(1e9))
    return t("part").select(k.alias("k"), layers.alias("layers"), slots.alias("slots"))


@register("""SELECT p_partkey AS k, CAST(greatest(1, CAST(floor(p_size * 1.5) AS BIGINT) // greatest(1, p_partkey % 5)) AS BIGINT) AS steps, CAST(greatest(1, ceil(greatest(1, ceil(p_size * 30 * 1.5 / 16)) / 25)) AS BIGINT) AS checkpoints, CAST(greatest(1, ceil(greatest(1, ceil(p_size * 30 * 1.5 / 16)) / 25)) AS BIGINT) * p_partkey * 12 AS checkpoint_bytes, p_partkey * 4 AS adapter_bytes FROM part""")
def training_sizes(spark, t):
    """Steps, checkpoints and their bytes."""
    n, bytes_, adapter = planning.disk_needs(F.col("p_partkey"), F.lit(0), F.col("p_size") * 30, F.lit(1.5), F.lit(16), F.lit(25))
    return t("part").select(F.col("p_partkey").alias("k"), planning.steps(F.col("p_size"), F.col("p_partkey") % 5, F.lit(1.5)).alias("steps"), n.alias("checkpoints"), bytes_.alias("checkpoint_bytes"), adapter.alias("adapter_bytes"))


@register("""SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'streamed' WHEN p_size * 1e9 <= 0.35 * 40e9 THEN 'resident' ELSE 'streamed' END AS path,
CASE WHEN p_partkey % 4 = 0 THEN 'ce' WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'mix' ELSE 'ce' END WHEN p_partkey % 3 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'kl' END ELSE 'ce' END AS loss FROM part""")
def training_choices(spark, t):
    """Where the weights live and which loss a teacher's answers train."""
    k = F.col("p_partkey")
    path = planning.memory_path(F.col("p_size") * F.lit(1e9), F.lit(40e9), F.when(k % 5 == 0, "streamed").otherwise("auto"))
    loss = planning.distill_loss(F.expr("case p_partkey % 3 when 0 then 'auto' when 1 then 'kl' else 'ce' end"), F.when(k % 4 != 0, "t"), F.lit("a"), F.when(F.col("p_size") % 2 == 0, "a"))
    return t("part").select(k.alias("k"), path.alias("path"), loss.alias("loss"))


@register("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 1 THEN CASE c_custkey % 3 WHEN 0 THEN 'j' WHEN 1 THEN 'none' END ELSE CASE c_custkey % 3 WHEN 0 THEN 'j' WHEN 1 THEN 'none' ELSE CASE WHEN c_custkey % 5 <> 0 THEN 't' END END END AS judge,
CASE WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 7 = 0 THEN 'judge_mean' ELSE 'token_f1' END WHEN c_custkey % 3 = 0 OR (c_custkey % 3 = 2 AND c_custkey % 5 <> 0) THEN 'judge_mean' ELSE 'token_f1' END AS metric FROM customer""")
def model_roles(spark, t):
    """Who judges, and which metric comes first."""
    k = F.col("c_custkey")
    judge, metric = planning.roles(F.when(k % 2 == 0, "open").otherwise("json"), F.when(k % 5 != 0, "t"), F.expr("case c_custkey % 3 when 0 then 'j' when 1 then 'none' end"), F.when(k % 7 == 0, "judge_mean").otherwise("token_f1"))
    return t("customer").select(k.alias("k"), judge.alias("judge"), metric.alias("metric"))


@register("""SELECT task, metric, (task = 'classification' AND metric = 'accuracy') OR (task = 'open' AND metric IN ('rouge_l', 'judge_mean')) OR metric = 'script_score' AS fits FROM (VALUES ('classification'), ('json'), ('open')) a(task), (VALUES ('accuracy'), ('rouge_l'), ('judge_mean'), ('script_score')) b(metric)""")
def metric_checks(spark, t):
    """Which metrics a task knows."""
    rows = spark.createDataFrame([(a, b) for a in ("classification", "json", "open") for b in ("accuracy", "rouge_l", "judge_mean", "script_score")], "task string, metric string")
    return rows.withColumn("fits", planning.metric_fits(F.col("task"), F.col("metric")))


@register("SELECT l_orderkey AS k, count(*) * (l_orderkey % 4 + 2 * (l_orderkey % 3)) AS requests FROM lineitem GROUP BY l_orderkey")
def judge_load(spark, t):
    """Requests that a judge would get."""
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return rows.select("k", planning.judge_requests_count(F.col("n"), F.col("k") % 4, F.col("k") % 3).alias("requests"))


@register("""WITH m AS (SELECT s_suppkey AS k, (1 + s_suppkey % 7) * 1e9 AS rate, (8 + s_suppkey % 5 * 16) * 1e9 AS ws, (40 + s_suppkey * 37 % 900) * 1e9 AS free, (1 + s_suppkey % 30) * 1.0::DOUBLE AS tf FROM supplier),
x AS (SELECT m.*, p::DOUBLE AS p FROM m, range(1, 400) r(p)),
y AS (SELECT *, p * 2e9 AS size, 2 * greatest(8, floor(sqrt(p) * 3)) * 8 * 128 * 2 AS kv FROM x),
z AS (SELECT *, size <= ws * 0.70 AS inside, greatest(1, least(512, floor(greatest(ws * 0.75 - CASE WHEN size <= ws * 0.70 THEN size ELSE 8e9 END, 1e9) / (364 * kv)))) AS batch FROM y),
s AS (SELECT k, p, size + 20 * 1073741824.0 > free AS over, ceil(2000 / batch) * 65 * size / CASE WHEN inside THEN 120e9 ELSE rate END + 2 * p * 1e9 * 2000 * 300 / (tf * 1e12) > 43200 AS late FROM z),
f AS (SELECT k, min(p) FILTER (WHERE over OR late) AS p FROM s GROUP BY k)
SELECT f.k, CAST(coalesce(f.p - 1, 399) AS INTEGER) AS billions, CASE WHEN s.over THEN 'disk' ELSE 'time' END AS "limit" FROM f LEFT JOIN s ON s.k = f.k AND s.p = f.p""")
def overnight_models(spark, t):
    """The largest model that each machine can judge with overnight."""
    k = F.col("s_suppkey")
    m = t("supplier").select(k.alias("k"), ((1 + k % 7) * F.lit(1e9)).alias("rate"), ((8 + k % 5 * 16) * F.lit(1e9)).alias("working_set"), ((40 + k * 37 % 900) * F.lit(1e9)).alias("free_disk"), ((1 + k % 30) * F.lit(1.0)).alias("tflops"))
    return planning.largest_overnight(m, 120e9).select("k", "billions", "limit")


@register("""WITH c AS (SELECT o_custkey AS plan, o_orderkey AS combo, o_orderkey % 5 AS student, o_orderkey % 7 AS teacher, o_orderkey % 2 = 0 AS judged, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS seconds FROM orders), f AS (SELECT *, seconds <= 100000 AS fits FROM c)
SELECT plan, combo, fits, coalesce(fits AND row_number() OVER (PARTITION BY plan ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, student DESC, teacher DESC, judged DESC, seconds, combo) = 1, false) AS recommended,
coalesce(count(*) FILTER (WHERE fits) OVER (PARTITION BY plan) = 0 AND seconds IS NOT NULL AND row_number() OVER (PARTITION BY plan ORDER BY seconds NULLS LAST, combo) = 1, false) AS closest FROM f""")
def deadline_plans(spark, t):
    """Combinations that fit a deadline, the one to recommend, or else the closest."""
    k = F.col("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("plan"), k.alias("combo"), (k % 5).alias("student"), (k % 7).alias("teacher"), (k % 2 == 0).alias("judged"), F.when(k % 11 != 0, F.col("o_totalprice")).alias("seconds"))
    return compare.deadline_plan(rows, "plan", "combo", 100000.0)
