"""Intake queries: records to rows, lines to prompts, training lines, splits and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators import chat, intake
from .examples import norm
from .registry import register

_RECORDS = """r AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE text END AS given, CASE doc_id % 11 WHEN 0 THEN ' ' WHEN 1 THEN text WHEN 2 THEN NULL ELSE '  ' || lang || ' ' END AS wanted, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END AS grp FROM documents)"""
_PROBLEM = """CASE WHEN given IS NULL OR trim(given) = '' THEN 'empty input' WHEN wanted IS NULL OR trim(wanted) = '' THEN 'empty output' WHEN length(regexp_replace(regexp_replace(wanted, '^\\s+', ''), '\\s+$', '')) > 100 THEN 'long label' END"""


def _records(t):
    given = F.expr("case doc_id % 7 when 0 then '  ' when 1 then null else text end")
    wanted = F.expr("case doc_id % 11 when 0 then ' ' when 1 then text when 2 then null else '  ' || lang || ' ' end")
    group = F.expr("case when doc_id % 3 = 0 then ' ' else source end")
    values = F.create_map(F.lit("text"), given, F.lit("label"), wanted, F.lit("group"), group)
    return t("documents").select(F.lit("f").alias("file"), F.col("doc_id").alias("row"), values.alias("values"))


@register(f"""WITH {_RECORDS}, p AS (SELECT *, {_PROBLEM} AS problem FROM r)
SELECT doc_id AS row, sha256(given) AS input, trim(wanted) AS output, nullif(trim(grp), '') AS "group" FROM p WHERE problem IS NULL""")
def mapped_rows(spark, t):
    """Records with an input and a short label, by column name."""
    good, _ = intake.map_rows(_records(t), "text", "label", "group", "classification")
    return good.select("row", F.sha2("input", 256).alias("input"), "output", "group")


@register(f"""WITH {_RECORDS}, p AS (SELECT *, {_PROBLEM} AS problem FROM r)
SELECT 'f' AS file, 'row ' || doc_id AS "where", problem FROM p WHERE problem IS NOT NULL
UNION ALL SELECT 'g', 'header', 'no column label' FROM (SELECT 1) WHERE (SELECT count(*) FROM labels) > 0""")
def mapping_issues(spark, t):
    """What is wrong with records that were not taken."""
    other = t("labels").select(F.lit("g").alias("file"), F.col("doc_id").alias("row"), F.create_map(F.lit("text"), F.lit("x"), F.lit("group"), F.lit("y")).alias("values"))
    return intake.map_rows(_records(t).unionByName(other), "text", "label", "group", "classification")[1]


@register("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '{"a": ' WHEN 2 THEN '' ELSE props END AS o FROM events)
SELECT event_id AS row, CASE event_id % 5 WHEN 0 THEN 'not an object' WHEN 1 THEN 'not JSON' WHEN 2 THEN 'empty output' ELSE 'good' END AS fate FROM r""")
def json_outputs(spark, t):
    """Outputs that must be JSON objects."""
    out = F.expr("case event_id % 5 when 0 then '[1, 2]' when 1 then '{\"a\": ' when 2 then '' else props end")
    records = t("events").select(F.lit("f").alias("file"), F.col("event_id").alias("row"), F.create_map(F.lit("x"), F.col("event_type"), F.lit("y"), out).alias("values"))
    good, bad = intake.map_rows(records, "x", "y", task="json")
    return good.select("row", F.lit("good").alias("fate")).unionAll(bad.select(F.regexp_extract("where", r"(\d+)", 1).try_cast("long"), "problem"))


_LINES = """case item_id % 20
when 0 then '{"prompt": "p", "expected": "e"}' when 1 then '{"prompt": "p", "answer": "a", "expected": "e"}' when 2 then '{"prompt": "p", "zeta": 1, "beta": 2}' when 3 then '{"prompt": "  "}' when 4 then '{"prompt": 5}'
when 5 then '{"messages": []}' when 6 then '{"messages": [{"role": "user", "content": "u"}, {"role": "robot", "content": "x"}]}' when 7 then '{"messages": [{"role": "user", "content": 7}]}' when 8 then '{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a", "weight": 2}]}'
when 9 then '{"messages": [{"role": "system", "content": "s"}]}' when 10 then '{"custom_id": "", "body": {"messages": [{"role": "user", "content": "u"}]}}' when 11 then '{"custom_id": "c", "body": [1]}' when 12 then '{"custom_id": "c", "body": {"messages": [{"role": "user", "content": "u"}], "max_tokens": 0}}'
when 13 then '{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a", "weight": 1}], "custom_id": 4}' when 14 then '{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a", "weight": 0}], "custom_id": "' || item_id || '"}' when 15 then '{"custom_id": "d' || (item_id div 40) || '", "body": {"messages": [{"role": "user", "content": "u"}], "max_tokens": 9}}'
when 16 then '{"x": 1}' when 17 then '"text"' when 18 then '{' else '{"prompt": "p", "system": "s", "answer": "a"}' end"""
_FAULTS = {1: "answer and expected in one row", 2: "unknown fields beta, zeta", 3: "prompt must be text", 4: "prompt must be text", 5: "messages must be a list that is not empty", 6: "unknown role", 7: "content must be text", 8: "weight must be 0 or 1", 9: "no user message", 10: "no custom_id", 11: "body must be an object", 12: "max_tokens must be a positive whole number", 13: "custom_id must be text", 16: "no shape", 17: "not an object", 18: "invalid JSON"}


@register("SELECT item_id, problem FROM benchmark JOIN (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in _FAULTS.items()) + ") f(k, problem) ON item_id % 20 = k UNION ALL SELECT item_id, 'duplicate custom_id' FROM benchmark WHERE item_id % 20 = 15 AND item_id % 40 <> 15")
def line_problems(spark, t):
    """The first problem of each JSON line that is no prompt, duplicate ids included."""
    lines = t("benchmark").select("item_id", F.expr(_LINES).alias("value"))
    return intake.prompt_rows(lines, "value", "item_id")[1]


@register("""SELECT item_id, CASE item_id % 20 WHEN 14 THEN CAST(item_id AS VARCHAR) WHEN 15 THEN 'd' || (item_id // 40) ELSE printf('row-%06d', item_id) END AS custom_id, CAST(CASE item_id % 20 WHEN 19 THEN 2 ELSE 1 END AS INTEGER) AS n_messages, CASE WHEN item_id % 20 IN (14, 19) THEN 'a' END AS target,
CAST(CASE item_id % 20 WHEN 15 THEN 9 ELSE 128 END AS INTEGER) AS max_tokens, CASE WHEN item_id % 20 = 0 THEN 'e' END AS expected FROM benchmark WHERE item_id % 20 IN (0, 14, 19) OR item_id % 40 = 15""")
def prompt_file(spark, t):
    """Prompts of JSON lines of all shapes."""
    lines = t("benchmark").select("item_id", F.expr(_LINES).alias("value"))
    rows, _ = intake.prompt_rows(lines, "value", "item_id")
    return rows.select("item_id", "custom_id", F.size("messages").alias("n_messages"), "target", "max_tokens", "expected")


@register("""SELECT event_id, sha256(trim(CASE event_id % 4 WHEN 0 THEN ' ' || event_type || ' ' ELSE event_type END)) AS answer FROM events WHERE event_id % 4 NOT IN (1, 2)""")
def distilled_answers(spark, t):
    """Training rows of distillation records without an error and with an answer."""
    answer = F.expr("case event_id % 4 when 0 then ' ' || event_type || ' ' when 1 then '  ' else event_type end")
    error = F.expr("case when event_id % 4 = 2 then 'failed' end")
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col("props").alias("content")))
    rows = intake.answer_rows(t("events").select("event_id", prompt.alias("messages"), answer.alias("answer"), error.alias("error")))
    return rows.select("event_id", F.sha2(F.try_element_at("messages", F.lit(-1))["content"], 256).alias("answer"))


@register("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id), n AS (SELECT conv_id, roles, list_filter(roles, lambda x: x <> 'system') AS talk FROM c)
SELECT conv_id, CASE WHEN roles[-1] <> 'assistant' THEN 'the last message is no answer' WHEN coalesce(talk[1], '') <> 'user' THEN 'the first message is no user''s' WHEN conv_id % 5 = 0 THEN 'weight on another role' WHEN conv_id % 5 = 1 THEN 'nothing to train on' END AS problem FROM n""")
def training_problems(spark, t):
    """What keeps conversations from being trained on; some weigh a user's turn, some weigh no answer."""
    rows = chat.messages(t("conversations"), "conv_id", "turn")
    weight = lambda m: F.when((F.col("conv_id") % 5 == 0) & (m["role"] == "user"), 1).when((F.col("conv_id") % 5 == 1) & (m["role"] == "assistant"), 0)
    weighed = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), weight(m).alias("weight")))
    return rows.select("conv_id", intake.training_problem(weighed).alias("problem"))


@register("""SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'lengths differ' WHEN 1 THEN 'top-k differs' END AS problem FROM embeddings WHERE len(embedding) > 2""")
def teacher_problems(spark, t):
    """Teachers' arrays that don't fit their tokens."""
    e = t("embeddings").filter("size(embedding) > 2")
    ids = F.array(F.lit(1), F.lit(2))
    two = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))
    odd = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))
    top = F.when(F.col("vec_id") % 4 == 0, F.slice(two, 1, 1)).when(F.col("vec_id") % 4 == 1, odd).otherwise(two)
    return e.select("vec_id", intake.teacher_problem(ids, top, two).alias("problem"))


@register(f"""WITH d AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'other' WHEN 3 THEN upper(lang) || ' ' ELSE lang END AS answer FROM documents)
SELECT id, CASE WHEN id % 6 > 2 THEN {norm('answer')} END AS target, CASE WHEN id % 6 < 2 THEN 'blank' WHEN id % 6 = 2 THEN 'outside' ELSE 'used' END AS fate FROM d""")
def teacher_answers(spark, t):
    """Training rows joined to a teacher's labels, with what becomes of each."""
    d = t("documents")
    answer = F.expr("case doc_id % 6 when 0 then null when 1 then '  ' when 2 then 'other' when 3 then upper(lang) || ' ' else lang end")
    answers = d.select(F.col("doc_id").alias("id"), answer.alias("answer")).filter("id % 6 <> 0")
    return intake.training_rows(d.select(F.col("doc_id").alias("id")), answers, ["en", "de", "fr", "es"]).select("id", "target", "fate")


_DEAL = """c AS (SELECT doc_id AS id, doc_id // 4 AS component, CASE WHEN doc_id // 4 % 5 = 0 THEN 'test' END AS given FROM documents), z AS (SELECT component, count(*) AS size, sha256('s3' || component) AS h FROM c WHERE given IS NULL GROUP BY 1),
o AS (SELECT component, sum(size) OVER (ORDER BY h, component ROWS UNBOUNDED PRECEDING) - size AS before FROM z), g AS (SELECT round_even(count(*) * 0.2, 0) AS goal FROM c)"""


@register(f"WITH {_DEAL} SELECT id, CASE WHEN given = 'test' THEN 'test' WHEN before < goal THEN 'val' ELSE 'train' END AS split, 'mixed' AS mode FROM c LEFT JOIN o USING (component), g")
def split_resolved(spark, t):
    """A supplied test split is kept, and a validation split dealt from the other rows in whole components."""
    rows = t("documents").select(F.col("doc_id").alias("id"), F.expr("case when doc_id div 4 % 5 = 0 then 'test' end").alias("given"))
    comps = t("documents").select(F.col("doc_id").alias("id"), F.expr("doc_id div 4").alias("component"))
    return intake.resolved_split(rows, comps, "s3", 0.1, 0.2)


@register("""WITH c AS (SELECT lang, least(count(*) FILTER (WHERE doc_id % 3 = 0), CASE WHEN lang = 'en' THEN 5 ELSE 1000 END) AS n_train, CASE WHEN lang = 'de' THEN 2 ELSE 10 END AS n_val, count(DISTINCT CASE WHEN lang = 'fr' THEN 'one' ELSE source END) AS n_labels FROM documents GROUP BY lang)
SELECT lang, 'few training rows' AS problem FROM c WHERE n_train < 8 UNION ALL SELECT lang, 'few validation rows' FROM c WHERE n_val < 4 UNION ALL SELECT lang, 'fewer than two classes' FROM c WHERE n_train > 0 AND n_labels < 2""")
def size_checks(spark, t):
    """Why splits are too small to build on."""
    c = t("documents").groupBy("lang").agg(F.count_if(F.col("doc_id") % 3 == 0).alias("a"), F.count_distinct(F.when(F.col("lang") == "fr", "one").otherwise(F.col("source"))).alias("n_labels"))
    c = c.select("lang", F.expr("least(a, case when lang = 'en' then 5 else 1000 end)").alias("n_train"), F.expr("case when lang = 'de' then 2 else 10 end").alias("n_val"), "n_labels")
    out = None
    for lang in ("en", "de", "fr", "es"):
        one = intake.size_problems(c.filter(F.col("lang") == lang), "classification").select(F.lit(lang).alias("lang"), "problem")
        out = one if out is None else out.unionAll(one)
    return out


@register("""WITH l AS (SELECT doc_id % 3 AS split, sha256(CAST(doc_id AS VARCHAR)) AS k, sha256(text) AS line FROM documents),
p AS (SELECT split, left(k, 2) AS r, sha256(string_agg(line, '' ORDER BY line)) AS part, count(*) AS n FROM l GROUP BY 1, 2)
SELECT split, sha256(string_agg(part, '' ORDER BY r)) AS digest, sum(n) AS n FROM p GROUP BY split""")
def split_fingerprints(spark, t):
    """A digest of the rows of each split."""
    rows = t("documents").withColumn("split", F.col("doc_id") % 3)
    return intake.split_digest(rows, "split", [F.col("doc_id").cast("string")], F.col("text"))


@register("""SELECT bool_and(expected IS NOT NULL AND length(expected) <= 64 AND len(list_filter(regexp_split_to_array(expected, '\\s+'), lambda x: x <> '')) <= 8) AS classification, CAST(greatest(16, ceil(max(length(coalesce(expected, ''))) / 4.0) + 4) AS INTEGER) AS max_tokens FROM (SELECT event_type || ' ' || props AS expected FROM events)""")
def expected_are_short(spark, t):
    """Whether expected values are labels, and the tokens that they take."""
    return intake.short_expected(t("events").select(F.concat("event_type", F.lit(" "), "props").alias("expected")), "expected")


@register("SELECT left(min(s_name), list_max(list_transform(range(0, CAST(least(length(min(s_name)), length(max(s_name))) AS BIGINT) + 1), lambda k: CASE WHEN left(min(s_name), CAST(k AS INTEGER)) = left(max(s_name), CAST(k AS INTEGER)) THEN k ELSE 0 END))) AS prefix FROM supplier")
def shared_prefix(spark, t):
    """The longest prefix of all names."""
    return intake.common_prefix(t("supplier"), "s_name")


@register("""SELECT item_id, CAST(2 AS INTEGER) AS untrained, CAST(1 AS INTEGER) AS student, sha256('Be brief.' || chr(10) || chr(10) || 'Classify the input into exactly one of these labels. Reply with the label only, spelled exactly as listed.' || chr(10) || 'Labels: a, b') AS system FROM benchmark""")
def prompt_views(spark, t):
    """What an untrained model and the student are shown."""
    untrained = intake.prompt_view(F.col("text"), "Be brief.", intake.label_contract(["a", "b"]))
    return t("benchmark").select("item_id", F.size(untrained).alias("untrained"), F.size(intake.prompt_view(F.col("text"), None)).alias("student"), F.sha2(untrained[0]["content"], 256).alias("system"))


@register("""SELECT item_id AS custom_id, '/v1/chat/completions' AS url, CAST(32 AS INTEGER) AS max_tokens, CASE item_id % 4 WHEN 0 THEN 'temperature' WHEN 1 THEN 'top_p,stop' WHEN 2 THEN 'greedy' ELSE '' END AS refused FROM benchmark""")
def request_guard(spark, t):
    """Requests with their decoding settings, and those that a greedy engine refuses."""
    rows = t("benchmark").select(F.col("item_id").alias("id"), "text")
    made = intake.request_rows(rows, intake.prompt_view(F.col("text"), None), F.lit("e"), 32)
    odd = F.when(F.col("custom_id") % 4 == 0, F.col("body").withField("temperature", F.lit(0.7))).when(F.col("custom_id") % 4 == 1, F.col("body").withField("top_p", F.lit(0.9)).withField("stop", F.array(F.lit("x")))).when(F.col("custom_id") % 4 == 2, F.col("body").withField("greedy", F.lit(False))).otherwise(F.col("body"))
    sent = made.withColumn("body", odd)
    return sent.select("custom_id", "url", F.col("body.max_tokens").alias("max_tokens"), F.array_join(intake.decoding_problems(F.col("body")), ",").alias("refused"))


@register("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(len(roles) - CASE WHEN roles[-1] = 'assistant' THEN 1 ELSE 0 END + CASE WHEN roles[1] = 'system' AND (len(roles) > 1 OR roles[-1] <> 'assistant') THEN 0 ELSE 1 END AS INTEGER) AS n_messages, sha256('Act.' || CASE WHEN roles[1] = 'system' THEN chr(10) || chr(10) || texts[1] ELSE '' END) AS system FROM c""")
def role_prompts(spark, t):
    """Conversations as one role sees them: a text before their system message, no answer at the end."""
    rows = chat.messages(t("conversations"), "conv_id", "turn").withColumn("m", intake.for_role(F.col("messages"), "Act.", drop_answer=True))
    return rows.select("conv_id", F.size("m").alias("n_messages"), F.sha2(F.get("m", F.lit(0))["content"], 256).alias("system"))


@register("SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY ALL")
def distinct_in_order(spark, t):
    """Distinct pairs by their first row."""
    return intake.ordered_distinct(t("documents"), ["source", "lang"], "doc_id")


@register(f"""SELECT doc_id, quality FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' Good ' WHEN 1 THEN 'BAD' ELSE 'odd' END AS quality FROM labels) WHERE {norm('quality')} NOT IN ('good', 'bad')""")
def outside_vocabulary(spark, t):
    """Labels that a vocabulary lacks."""
    from ..operators.rows import outside_vocabulary as outside

    rows = t("labels").select("doc_id", F.expr("case doc_id % 3 when 0 then ' Good ' when 1 then 'BAD' else 'odd' end").alias("quality"))
    return outside(rows, "quality", spark.createDataFrame([("good",), ("Bad",)], "label string"))


@register(f"""WITH p AS (SELECT doc_id, sha256({norm('text')}) AS k, lower(trim(source)) AS g, CASE WHEN doc_id % 7 = 0 THEN 'test' ELSE 'train' END AS split FROM documents WHERE source IS NOT NULL), s AS (SELECT g, split, min(doc_id) AS first FROM p GROUP BY ALL)
SELECT a.g AS value, a.split AS split_a, b.split AS split_b, a.first AS first_a, b.first AS first_b FROM s a JOIN s b ON a.g = b.g AND a.split < b.split""")
def group_overlap(spark, t):
    """Groups that two supplied splits share."""
    rows = t("documents").filter("source is not null").select("doc_id", normalized(F.col("source")).alias("value"), F.expr("case when doc_id % 7 = 0 then 'test' else 'train' end").alias("split"))
    sides = rows.groupBy("value", "split").agg(F.min("doc_id").alias("first"))
    a, b = sides.alias("a"), sides.alias("b")
    return a.join(b, F.expr("a.value = b.value and a.split < b.split")).select(F.col("a.value").alias("value"), F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b"), F.col("a.first").alias("first_a"), F.col("b.first").alias("first_b"))


_TRAIN = """case item_id % 8 when 0 then '{"prompt": "p", "answer": "a' || item_id || '"}' when 1 then '{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "b"}]}' when 2 then '{"teacher": {"model": "t"}, "messages": [{"role": "user", "content": "u"}], "completion": " c' || item_id || ' "}'
when 3 then '{"teacher": {"model": "t"}, "messages": [{"role": "user", "content": "u"}], "completion": "  "}' when 4 then '{"teacher": {"model": "t"}, "messages": [{"role": "user", "content": "u"}], "target": "d", "error": "e"}' when 5 then '{"prompt": "p"}' when 6 then '{"messages": [{"role": "user", "content": "u"}]}' else ' ' end"""


@register("""SELECT item_id, CASE item_id % 8 WHEN 0 THEN 'a' || item_id WHEN 1 THEN 'b' WHEN 2 THEN 'c' || item_id ELSE 'no answer' END AS outcome FROM benchmark WHERE item_id % 8 IN (0, 1, 2, 5, 6)""")
def training_file(spark, t):
    """Answers of a training file of mixed lines, and the lines without one."""
    rows, issues = intake.training_file(t("benchmark").select("item_id", F.expr(_TRAIN).alias("value")), "value", "item_id")
    return rows.select("item_id", F.try_element_at("messages", F.lit(-1))["content"].alias("outcome")).unionAll(issues.select("item_id", "problem"))


@register("SELECT event_id, '{\"a\":' || (event_id % 9) || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS target FROM events")
def target_texts(spark, t):
    """Records in the form that a model is trained to write."""
    text = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": '), (F.col("event_id") % 9).cast("string"), F.lit("}"))
    return t("events").select("event_id", intake.target_text("json", text).alias("target"))


@register("""WITH f AS (SELECT item_id % 5 AS file, count(*) AS n FROM benchmark GROUP BY 1), h AS (SELECT count(*) FILTER (WHERE item_id % 5 = 1 AND item_id % 2 = 0) AS e, count(*) FILTER (WHERE item_id % 5 = 2 AND item_id % 2 = 0) AS c FROM benchmark)
SELECT file, n AS n_rows, CASE WHEN file = 4 THEN n ELSE 0 END AS issues, CASE file WHEN 0 THEN 'plain' WHEN 1 THEN 'plain' WHEN 2 THEN 'chat,plain' WHEN 3 THEN 'distill' ELSE '' END AS shape, CASE file WHEN 0 THEN n WHEN 1 THEN e ELSE 0 END AS expected, CASE WHEN file = 3 THEN n ELSE 0 END AS targets,
CASE file WHEN 0 THEN 'eval' WHEN 1 THEN 'eval' WHEN 3 THEN 'distillation records' ELSE 'prompts' END AS use, CASE file WHEN 1 THEN 'expected on some rows' WHEN 2 THEN 'mixed shapes' WHEN 4 THEN 'lines with issues' END AS problem FROM f, h""")
def file_summaries(spark, t):
    """What each file of JSON lines is for, and what is wrong with it."""
    value = F.expr("""case item_id % 5 when 0 then '{"prompt": "p", "expected": "e"}' when 1 then case when item_id % 2 = 0 then '{"prompt": "p", "expected": 1}' else '{"prompt": "p"}' end
when 2 then case when item_id % 2 = 0 then '{"messages": [{"role": "user", "content": "u"}]}' else '{"prompt": "p"}' end when 3 then '{"teacher": {"m": 1}, "messages": [{"role": "user", "content": "u"}], "completion": "c"}' else '{"x": 1}' end""")
    lines = t("benchmark").select("item_id", (F.col("item_id") % 5).alias("file"), value.alias("value"))
    return intake.file_summary(lines, "value", "item_id", "file")


@register("""SELECT * FROM (SELECT 'k' AS key, min(item_id) AS line, CAST(0 AS INTEGER) AS "at" FROM benchmark UNION ALL SELECT 'b', min(item_id), 1 FROM benchmark WHERE item_id % 3 = 1 UNION ALL SELECT 'a', min(item_id), 2 FROM benchmark WHERE item_id % 3 = 1)""")
def json_columns(spark, t):
    """Columns of JSON lines in the order in which they first come up."""
    value = F.expr("""case when item_id % 3 = 1 then '{"k": 1, "b": 2, "a": 3}' when item_id % 3 = 2 then '{"a": 1, "k": 2}' else '{"k": 1}' end""")
    return intake.json_columns(t("benchmark").select("item_id", value.alias("value")), "value", "item_id")


@register("""WITH x AS (SELECT conv_id, turn, role, length(text) AS tokens, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations),
y AS (SELECT *, sum(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS sys, sum(CASE WHEN role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY exchange DESC RANGE UNBOUNDED PRECEDING) AS tail FROM x),
z AS (SELECT *, min(CASE WHEN role <> 'system' THEN tail END) OVER (PARTITION BY conv_id) AS last FROM y),
k AS (SELECT conv_id, role, turn, CASE WHEN last + sys <= 600 THEN role = 'system' OR tail + sys <= 600 END AS kept FROM z)
SELECT conv_id, count(*) FILTER (WHERE NOT coalesce(kept, true)) AS dropped, bool_or(coalesce(kept AND role = 'assistant' AND turn % 4 <> 1, false)) AS usable FROM k GROUP BY conv_id""")
def trainable_conversations(spark, t):
    """Which truncated conversations still have something to train on."""
    turns = t("conversations").withColumn("tokens", F.length("text")).withColumn("weight", F.when(F.col("turn") % 4 == 1, 0))
    return chat.trainable_left(chat.truncated(turns, "conv_id", "turn", "tokens", 600), "conv_id", "weight")
