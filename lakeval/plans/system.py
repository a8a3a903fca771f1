"""Audits, run records, planning arithmetic, JSON scoring and resumable row jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontools, planning
from ..functions.text import slug
from ..operators import compare, evaluate, reports
from ..streaming import rowjob
from ..workspace import Workspace
from .registry import register


@register("""WITH m AS (SELECT max(event_id) + 1 AS ids FROM events), w AS (SELECT event_id AS id FROM events, m WHERE event_id < ids * 4 // 5), c AS (SELECT event_id % (ids * 9 // 10) AS id, count(*) AS n FROM events, m WHERE event_id % 10 <> 3 GROUP BY 1)
SELECT id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'extra' ELSE 'duplicated' END AS problem FROM w FULL OUTER JOIN c USING (id) WHERE n IS NULL OR w.id IS NULL OR n > 1""")
def row_audit(spark, t):
    """Missing, extra and duplicated rows of a job: of n events, four fifths of n ids are wanted and every event
    but each tenth has a result, whose ids start afresh after nine tenths."""
    ids = F.broadcast(t("events").agg((F.max("event_id") + 1).alias("ids")))
    events = t("events").select("event_id").crossJoin(ids)
    wanted = events.filter("event_id < ids * 4 div 5").select(F.col("event_id").alias("id"))
    results = events.filter("event_id % 10 <> 3").select(F.expr("event_id % (ids * 9 div 10)").alias("id"))
    return evaluate.row_audit(wanted, results, "id")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_rows(spark, t):
    """Rows that have no result yet."""
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@register("SELECT event_type AS engine, user_id % 3 AS host, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2")
def producer_rollup(spark, t):
    """Rows by producer."""
    return t("events").groupBy(F.col("event_type").alias("engine"), (F.col("user_id") % 3).alias("host")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@register("""WITH l AS (SELECT user_id, event_id, event_type, CASE WHEN event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM l) SELECT user_id, event_type, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM i GROUP BY user_id, event_type, g""")
def producer_islands(spark, t):
    """Ranges of adjacent rows of one producer."""
    return evaluate.islands(t("events").select("user_id", "event_id", "event_type"), "event_id", "event_type", ["user_id"])


@register("""WITH l AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was, event_type AS now FROM events) SELECT was, now, count(*) AS n FROM l WHERE was <> now GROUP BY ALL""")
def engine_transitions(spark, t):
    """Changes from one producer to the next."""
    from pyspark.sql import Window

    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t("events").select(was.alias("was"), F.col("event_type").alias("now")).filter("was <> now").groupBy("was", "now").agg(F.count("*").alias("n"))


@register("SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS whole FROM lineitem GROUP BY 1")
def contiguous_steps(spark, t):
    """Whether steps have no gap."""
    return compare.steps_in_order(t("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@register("""WITH a AS (SELECT o_orderkey % 500 AS k, max(o_orderstatus) AS s, max(o_orderpriority) AS p FROM orders GROUP BY 1), x AS (SELECT k, 'status' AS path, s AS value FROM a WHERE k % 2 = 0 UNION ALL SELECT k, 'priority', p FROM a),
y AS (SELECT k, 'status' AS path, CASE WHEN k % 3 = 0 THEN 'Z' ELSE s END AS value FROM a UNION ALL SELECT k, 'priority', p FROM a WHERE k % 5 <> 0)
SELECT k, path, x.value AS was, y.value AS now FROM x FULL OUTER JOIN y USING (k, path) WHERE x.value IS DISTINCT FROM y.value""")
def structural_diff(spark, t):
    """Paths on which two sets of documents differ."""
    a = t("orders").groupBy((F.col("o_orderkey") % 500).alias("k")).agg(F.max("o_orderstatus").alias("s"), F.max("o_orderpriority").alias("p"))
    row = lambda path, c: (F.lit(path).alias("path"), c.alias("value"))
    x = a.filter("k % 2 = 0").select("k", *row("status", F.col("s"))).unionByName(a.select("k", *row("priority", F.col("p"))))
    y = a.select("k", *row("status", F.when(F.col("k") % 3 == 0, "Z").otherwise(F.col("s")))).unionByName(a.filter("k % 5 <> 0").select("k", *row("priority", F.col("p"))))
    return compare.structural_diff(x, y, ["k"])


@register("""WITH c AS (SELECT c_custkey AS run, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '-' WHEN 2 THEN 'a|' || c_nationkey ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 <> 2 THEN c_nationkey END AS nation, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS score FROM customer),
r AS (SELECT run, score, sha256('{"segment":' || CASE WHEN segment IS NULL THEN 'null' ELSE '"' || segment || '"' END || ',"nation":' || coalesce(CAST(nation AS VARCHAR), 'null') || '}') AS protocol FROM c)
SELECT run, protocol, score, row_number() OVER (PARTITION BY protocol ORDER BY score DESC NULLS LAST, run) AS rank FROM r""")
def runs_ranked(spark, t):
    """Runs ranked within their protocol, unscored last; null and look-alike values are protocols of their own."""
    segment = F.expr("case c_custkey % 5 when 0 then null when 1 then '-' when 2 then 'a|' || c_nationkey else c_mktsegment end")
    runs = t("customer").select(F.col("c_custkey").alias("run"), segment.alias("segment"), F.when(F.col("c_custkey") % 5 != 2, F.col("c_nationkey")).alias("nation"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")).alias("score"))
    grouped = compare.protocol_groups(runs, ["segment", "nation"])
    return compare.ranked_within(grouped, "protocol", "score", "run").select("run", "protocol", "score", "rank")


@register("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def bounded_history(spark, t):
    """The last three records of each key."""
    return compare.last_n(t("events").select("user_id", "event_id"), ["user_id"], "event_id", 3)


@register("""WITH a AS (SELECT event_id AS step, value AS x, value * (1 + (event_id % 7) / 1000.0::DOUBLE) AS y FROM events), g AS (SELECT step, round(abs(x - y) / greatest(abs(x), abs(y), 1e-12), 9) AS gap FROM a)
SELECT count(*) AS n, max(gap) AS worst, round(avg(gap), 9) AS mean, arg_min(step, (-gap, step)) AS "at" FROM g""")
def loss_curves(spark, t):
    """How far two loss curves are apart."""
    e = t("events")
    other = e.select(F.col("event_id").alias("step"), (F.col("value") * (1 + (F.col("event_id") % 7) / 1000.0)).alias("loss"))
    return compare.loss_gap(e.select(F.col("event_id").alias("step"), F.col("value").alias("loss")), other)


@register("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * power(0.7::DOUBLE, i) * CASE WHEN i = n - 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END), 6) AS ema FROM r GROUP BY 1""")
def step_time_ema(spark, t):
    """Moving average of each user's values."""
    return compare.ema(t("events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").withColumn("ema", F.round("ema", 6))


@register("""SELECT round(avg(greatest(0.2, least(5.0, value / (1 + event_id % 40)))), 9) AS ratio FROM events WHERE 1 + event_id % 40 >= 30""")
def running_ratio(spark, t):
    """Mean of actual by estimate within bounds, short stages left out."""
    estimate = 1 + F.col("event_id") % 40
    return t("events").filter(estimate >= 30).agg(F.round(F.avg(F.greatest(F.lit(0.2), F.least(F.lit(5.0), F.col("value") / estimate))), 9).alias("ratio"))


@register("""WITH e AS (SELECT * FROM (VALUES ('fast', 4e13, 3e9), ('slow', 5e12, 1e9)) v(engine, flops, speed)), s AS (SELECT * FROM (VALUES ('small', 5e8), ('mid', 1.5e9), ('large', 7e9)) v(student, p)),
te AS (SELECT * FROM (VALUES ('small', 5e8), ('mid', 1.5e9), ('large', 7e9)) v(teacher, tp)), c AS (SELECT engine, student, teacher, 6.0 * p * 300000 * 3 / flops + ceil(500.0 / 64) * 129 * (tp * 2 / speed) AS seconds FROM e, s, te WHERE tp > p)
SELECT engine, student, teacher, round(seconds, 3) AS seconds, seconds <= 7200 AS fits, row_number() OVER (ORDER BY CASE WHEN seconds <= 7200 THEN 0 ELSE 1 END, seconds, engine, student, teacher) AS rank FROM c""")
def deadline_combos(spark, t):
    """Combinations of engine, student and a larger teacher, with their time and fit."""
    from ..operators.baselines import ranked

    e = spark.createDataFrame([("fast", 4e13, 3e9), ("slow", 5e12, 1e9)], "engine string, flops double, speed double")
    s = spark.createDataFrame([("small", 5e8), ("mid", 1.5e9), ("large", 7e9)], "student string, p double")
    te = s.select(F.col("student").alias("teacher"), F.col("p").alias("tp"))
    train = planning.train_seconds(F.col("p"), F.lit(300000), F.lit(3), F.col("flops"))
    teach = planning.decode_seconds(F.lit(500.0), F.lit(64), F.lit(128), F.col("tp") * 2 / F.col("speed"))
    rows = e.join(F.broadcast(s.join(F.broadcast(te), F.expr("tp > p")))).withColumn("seconds", train + teach).withColumn("fits", F.col("seconds") <= 7200)
    out = ranked(rows, [F.when(F.col("fits"), 0).otherwise(1), F.col("seconds"), F.col("engine"), F.col("student"), F.col("teacher")])
    return out.select("engine", "student", "teacher", F.round("seconds", 3).alias("seconds"), "fits", "rank")


@register("""WITH x AS (SELECT p_partkey AS k, p_retailprice AS price, p_size AS size FROM part) SELECT k, round(2.0 * price * 1e6 * size * 100 / 4e13, 9) AS prefill, round(6.0 * price * 1e6 * size * 100 * 2 / 4e13, 9) AS train, greatest(1, least(64, CAST(floor(price / size) AS BIGINT))) AS batch FROM x""")
def cost_model(spark, t):
    """Prefill, training and batch estimates."""
    p, tokens, flops = F.col("p_retailprice") * 1e6, F.col("p_size") * 100, F.lit(4e13)
    batch = planning.batch_by_memory(F.col("p_retailprice"), F.col("p_size"), F.lit(64).cast("long"))
    return t("part").select(F.col("p_partkey").alias("k"), F.round(planning.prefill_seconds(p, tokens, flops), 9).alias("prefill"), F.round(planning.train_seconds(p, tokens, F.lit(2), flops), 9).alias("train"), batch.alias("batch"))


@register("SELECT s_suppkey, regexp_replace(s_name || ' / ' || s_nationkey, '[^A-Za-z0-9._-]+', '-', 'g') AS slug FROM supplier")
def slugs(spark, t):
    """Names made safe for files."""
    return t("supplier").select("s_suppkey", slug(F.concat("s_name", F.lit(" / "), F.col("s_nationkey").cast("string"))).alias("slug"))


@register("SELECT o_custkey % 50 AS plan, CASE WHEN count(*) = count(CASE WHEN o_orderkey % 97 <> 0 THEN 1 END) THEN count(*) END AS total FROM orders GROUP BY 1")
def plan_totals(spark, t):
    """Totals that are unknown where any part is."""
    part = F.when(F.col("o_orderkey") % 97 != 0, 1)
    return t("orders").groupBy((F.col("o_custkey") % 50).alias("plan")).agg(compare.total_or_null(part).alias("total"))


_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer"}, "z": {"type": "integer"}}, "required": ["k"], "additionalProperties": False}


@register("""WITH a AS (SELECT event_id % 7 AS m FROM events)
SELECT count(*) AS n_rows, round(avg(CASE WHEN m IN (0, 1, 2, 4, 6) THEN 1.0 ELSE 0 END), 9) AS parseable, round(avg(CASE WHEN m IN (0, 1, 4) THEN 1.0 ELSE 0 END), 9) AS valid, round(avg(CASE WHEN m = 0 THEN 1.0 ELSE 0 END), 9) AS whole, count(*) FILTER (WHERE m IN (4, 6)) AS extra, count(*) FILTER (WHERE m = 5) AS failed,
round(avg(CASE WHEN m IN (0, 4) THEN 1.0 ELSE 0 END), 9) AS field_k, round(avg(CASE WHEN m IN (0, 1) THEN 1.0 ELSE 0 END), 9) AS field_z, round((round(avg(CASE WHEN m IN (0, 4) THEN 1.0 ELSE 0 END), 9) + round(avg(CASE WHEN m IN (0, 1) THEN 1.0 ELSE 0 END), 9)) / 2, 9) AS mean_field FROM a""")
def json_metrics(spark, t):
    """JSON outputs against a schema and the record wanted: a field that neither has is right, one too many
    fails the record, and what breaks the schema earns nothing."""
    output = F.expr("case event_id % 7 when 0 then '```json ' || props || '```' when 1 then replace(props, ': ', ': 1') when 2 then '{\"k\": \"x\"}' when 3 then 'none' when 4 then replace(props, '}', '') || ', \"z\": 1}' when 6 then replace(props, '}', '') || ', \"y\": 1}' end")
    s = t("events").select(output.alias("output"), "props").withColumn("s", jsontools.json_scorer(_SCHEMA)("props", "output")).withColumn("failed", F.col("output").isNull())
    return reports.json_metrics(s, ["k", "z"])


@register("SELECT event_id, sha256('{\"a\":' || CAST(event_id AS VARCHAR) || ',\"k\":' || json_extract_string(props, '$.k') || '}') AS digest FROM events")
def canonical_digest(spark, t):
    """Digest of canonical JSON."""
    text = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return t("events").select("event_id", jsontools.json_digest(text).alias("digest"))


@register("SELECT event_id AS custom_id, upper(event_type) AS answer FROM events WHERE event_type <> 'error'")
def resumable_row_job(spark, t):
    """A row job over a stream of files, stopped in the middle and resumed."""
    ws = Workspace(spark, "rowjob")
    source, sink, state = (f"{ws.base}/{d}" for d in ("in", "out", "state"))
    rows = t("events").filter("event_type <> 'error'").select(F.col("event_id").alias("custom_id"), F.col("event_type").alias("prompt"))
    rows.filter("custom_id % 2 = 0").write.parquet(source)
    job = rowjob.RowJob(spark, source, sink, state, identity={"model": "upper", "version": 1}, schema=rows.schema)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(answer=pdf.prompt.str.upper())[["custom_id", "answer"]]

    job.run(run, "custom_id long, answer string")
    rows.filter("custom_id % 2 = 1 or custom_id % 10 = 0").write.mode("append").parquet(source)
    job.run(run, "custom_id long, answer string")
    return job.results()


@register("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def hourly_progress(spark, t):
    """Rows done by hour and kind."""
    return t("events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
