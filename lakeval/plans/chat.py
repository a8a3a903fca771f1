"""Chat rows over the conversations table, and JSON lines put together from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat
from ..sources import files
from .registry import register

_CONV = """c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)"""


@register(f"""WITH {_CONV} SELECT conv_id, printf('row-%06d', conv_id) AS custom_id, CASE WHEN roles[-1] = 'assistant' THEN sha256(texts[-1]) END AS target, CAST(len(roles) - CASE WHEN roles[-1] = 'assistant' THEN 1 ELSE 0 END AS INTEGER) AS n_messages, 128 AS max_tokens,
list_contains(roles, 'user') AND len(list_filter(roles, lambda r: r NOT IN ('system', 'user', 'assistant', 'tool'))) = 0 AND len(list_filter(texts, lambda x: x IS NULL)) = 0 AS valid FROM c""")
def chat_rows(spark, t):
    """Batch rows of conversations: id, target, messages that are left, validity."""
    rows = chat.messages(t("conversations"), "conv_id", "turn").withColumn("valid", chat.valid(F.col("messages")))
    return chat.batch_rows(rows, "conv_id").select("conv_id", "custom_id", F.sha2("target", 256).alias("target"), F.size("messages").alias("n_messages"), "max_tokens", "valid")


@register(f"""WITH {_CONV} SELECT conv_id, CAST(len(roles) + CASE WHEN roles[1] = 'system' THEN 0 ELSE 1 END AS INTEGER) AS n_messages, CASE WHEN roles[1] = 'system' THEN sha256(texts[1]) ELSE sha256('Be brief.') END AS system FROM c""")
def system_prepended(spark, t):
    """A system message in front of conversations without one."""
    rows = chat.messages(t("conversations"), "conv_id", "turn").withColumn("m", chat.with_system(F.col("messages"), F.lit("Be brief.")))
    return rows.select("conv_id", F.size("m").alias("n_messages"), F.sha2(F.get("m", F.lit(0))["content"], 256).alias("system"))


@register("""WITH x AS (SELECT conv_id, turn, role, length(text) AS tokens, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations),
y AS (SELECT *, sum(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS sys, sum(CASE WHEN role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY exchange DESC RANGE UNBOUNDED PRECEDING) AS tail FROM x),
z AS (SELECT *, min(CASE WHEN role <> 'system' THEN tail END) OVER (PARTITION BY conv_id) AS last FROM y)
SELECT conv_id, turn, exchange, CASE WHEN last + sys <= 600 THEN role = 'system' OR tail + sys <= 600 END AS kept FROM z""")
def truncate_exchanges(spark, t):
    """Turns left after dropping whole exchanges from the left."""
    turns = t("conversations").withColumn("tokens", F.length("text"))
    return chat.truncated(turns, "conv_id", "turn", "tokens", 600).select("conv_id", "turn", "exchange", "kept")


@register("""WITH l AS (SELECT doc_id, length(text) AS n FROM documents), p AS (SELECT doc_id, n, (row_number() OVER (ORDER BY n, doc_id) - 1) // 16 AS batch FROM l)
SELECT doc_id, n, batch, CAST(ceil(max(n) OVER (PARTITION BY batch) / 32.0) * 32 AS BIGINT) AS padded, sha256('e1' || CAST(batch AS VARCHAR)) AS draw FROM p""")
def length_buckets(spark, t):
    """Micro-batches of like length with their padded length and order."""
    rows = t("documents").select("doc_id", F.length("text").alias("n"))
    return chat.length_buckets(rows, "doc_id", "n", 16, "e1").select("doc_id", "n", "batch", "padded", "draw")


_LINES = """l AS (SELECT item_id, CASE item_id % 5
WHEN 0 THEN '{"prompt": "p' || CAST(item_id AS VARCHAR(20)) || '", "system": "s", "expected": "e"}'
WHEN 1 THEN '{"messages": [{"role": "user", "content": "c' || CAST(item_id AS VARCHAR(20)) || '"}, {"role": "assistant", "content": "a", "weight": 1}]}'
WHEN 2 THEN '{"custom_id": "x", "body": {"messages": [{"role": "user", "content": "b' || CAST(item_id AS VARCHAR(20)) || '"}], "max_tokens": 5}}'
WHEN 3 THEN '{"prompt": ' WHEN 4 THEN '[1, 2]' END AS value FROM benchmark)"""


def _lines(t):
    expr = _LINES.split("CASE", 1)[1].rsplit("END", 1)[0]
    return t("benchmark").select("item_id", F.expr("CASE" + expr + "END").alias("value"))


@register(f"""WITH {_LINES} SELECT item_id, CASE item_id % 5 WHEN 3 THEN 'invalid JSON' WHEN 4 THEN 'not an object' END AS issue, CASE item_id % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'chat' WHEN 2 THEN 'batch' END AS shape,
CAST(CASE item_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS INTEGER) AS n_messages, CASE item_id % 5 WHEN 0 THEN 's' WHEN 1 THEN 'c' || item_id WHEN 2 THEN 'b' || item_id END AS first FROM l""")
def parse_lines(spark, t):
    """Shape, issue and messages of JSON lines."""
    v = F.col("value")
    m = files.line_messages(v)
    return _lines(t).select("item_id", files.line_issue(v).alias("issue"), files.line_shape(v).alias("shape"), F.when(m.isNotNull(), F.size(m)).alias("n_messages"), F.get(m, F.lit(0))["content"].alias("first"))


@register(f"WITH {_LINES} SELECT count(*) AS n_rows, count(*) FILTER (WHERE item_id % 5 >= 3) AS issues, 'batch,chat,plain' AS shapes, 'some' AS expected FROM l")
def check_file(spark, t):
    """Summary of a file of JSON lines."""
    return files.check_lines(_lines(t))


@register("""WITH r AS (SELECT event_id, 'row-' || (event_id % 700) AS custom_id, event_type AS text, value FROM events), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY event_id DESC) = 1)
SELECT custom_id, event_id, text, value FROM l""")
def last_result_wins(spark, t):
    """The last line of each id."""
    from ..operators.rows import first_by

    r = t("events").select("event_id", F.concat(F.lit("row-"), (F.col("event_id") % 700).cast("string")).alias("custom_id"), F.col("event_type").alias("text"), "value")
    return first_by(r, ["custom_id"], [F.desc("event_id")])


@register("""WITH m AS (SELECT max(item_id) + 1 AS items FROM benchmark), p AS (SELECT item_id, text AS prompt FROM benchmark), r AS (SELECT event_id, event_id % items AS item_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE props END AS answer FROM events, m)
SELECT row_number() OVER (ORDER BY item_id, event_id) AS place, item_id, sha256(prompt) AS prompt, answer FROM p JOIN r USING (item_id) WHERE answer IS NOT NULL""")
def distill_records(spark, t):
    """Answers without errors, joined to their prompts in input order; event ids go round all items.

    The place is counted in two steps, by item and then within an item, so no task holds all rows."""
    from pyspark.sql import Window

    items = F.broadcast(t("benchmark").agg((F.max("item_id") + 1).alias("items")))
    answers = t("events").crossJoin(items).select("event_id", (F.col("event_id") % F.col("items")).alias("item_id"), F.when(F.col("event_id") % 9 != 0, F.col("props")).alias("answer"))
    joined = t("benchmark").select("item_id", F.sha2("text", 256).alias("prompt")).join(answers.filter("answer is not null"), "item_id")
    each = joined.groupBy("item_id").agg(F.count("*").alias("n"))
    base = each.select("item_id", (F.sum("n").over(Window.orderBy("item_id")) - F.col("n")).alias("base"))
    own = F.row_number().over(Window.partitionBy("item_id").orderBy("event_id"))
    return joined.withColumn("own", own).join(base, "item_id").select((F.col("base") + F.col("own")).alias("place"), "item_id", "prompt", "answer")


@register("""WITH v AS (SELECT item_id FROM benchmark), c(model) AS (VALUES ('base'), ('tuned'), ('teacher')), o(turn) AS (VALUES ('ab'), ('ba'))
SELECT 'point' AS kind, model AS who, item_id, '-' AS turn, model || '/' || item_id AS id FROM v, c
UNION ALL SELECT 'pair', a.model || ':' || b.model, item_id, turn, a.model || ':' || b.model || '/' || item_id || '/' || turn FROM v, c a, c b, o WHERE a.model < b.model""")
def judge_requests(spark, t):
    """Each comparator by row, and each pair by row in both orders."""
    v = t("benchmark").select("item_id")
    c = F.broadcast(spark.createDataFrame([("base",), ("tuned",), ("teacher",)], "model string"))
    one = v.join(c).select(F.lit("point").alias("kind"), F.col("model").alias("who"), "item_id", F.lit("-").alias("turn"), F.concat_ws("/", "model", F.col("item_id").cast("string")).alias("id"))
    pairs = c.alias("a").join(c.alias("b"), F.expr("a.model < b.model")).select(F.concat_ws(":", "a.model", "b.model").alias("who"), F.explode(F.array(F.lit("ab"), F.lit("ba"))).alias("turn"))
    two = v.join(F.broadcast(pairs)).select(F.lit("pair").alias("kind"), "who", "item_id", "turn", F.concat_ws("/", "who", F.col("item_id").cast("string"), "turn").alias("id"))
    return one.unionByName(two)


@register("""WITH s AS (SELECT conv_id, turn, regexp_replace(trim(text), '\\s+', ' ', 'g') AS seg FROM conversations), f AS (SELECT conv_id, string_agg(seg, ' ' ORDER BY turn) AS text FROM s GROUP BY conv_id)
SELECT min(conv_id) AS conv_id, sha256(lower(text)) AS digest FROM f GROUP BY lower(text)""")
def flattened_segments(spark, t):
    """Segments put together as one text, texts that differ in case alone once."""
    seg = t("conversations").select("conv_id", "turn", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("seg"))
    whole = seg.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "seg"))), lambda x: x["seg"]), " ").alias("text"))
    return whole.groupBy(F.lower("text").alias("low")).agg(F.min("conv_id").alias("conv_id")).select("conv_id", F.sha2("low", 256).alias("digest"))


@register("""SELECT count(*) AS lines, count(DISTINCT conv_id) AS examples, sum(length(text)) AS tokens, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS trained, count(*) FILTER (WHERE length(text) > 400) AS truncated, max(length(text)) AS longest FROM conversations""")
def dataset_statistics(spark, t):
    """Lines, examples and tokens of a training set."""
    n = F.length("text")
    return t("conversations").agg(F.count("*").alias("lines"), F.count_distinct("conv_id").alias("examples"), F.sum(n).alias("tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("trained"), F.count_if(n > 400).alias("truncated"), F.max(n).alias("longest"))
