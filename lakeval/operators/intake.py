"""From records and JSON lines to example rows, prompts and training lines, each with what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized, strip
from . import chat

#: Lengths and counts from which an input is refused.
LABEL_CHARS = 100
LEAST_TRAIN, LEAST_VAL = 8, 4
PLAIN_FIELDS = ("prompt", "expected", "answer", "system", "custom_id", "max_tokens")


def map_rows(records: DataFrame, given: str, wanted: str, group: str | None = None, task: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of records (file, row, values map): input, output and group by column name.

    A file none of whose records has a named column has an issue in its header and gives no rows. A row
    needs an input and an output that are not blank; a classification's label has at most 100 characters;
    JSON outputs must be objects. Outputs lose white space at their ends but for JSON; a blank group is none."""
    named = [c for c in (given, wanted, group) if c]
    heads = records.groupBy("file").agg(*(F.max(F.map_contains_key("values", F.lit(c))).alias(f"has{i}") for i, c in enumerate(named)))
    lacks = F.explode(F.array_compact(F.array(*(F.when(~F.col(f"has{i}"), F.lit(f"no column {c}")) for i, c in enumerate(named)))))
    header = heads.select("file", F.lit("header").alias("where"), lacks.alias("problem"))
    at = lambda c: F.try_element_at("values", F.lit(c))
    rows = records.join(header.select("file").distinct(), "file", "left_anti")
    rows = rows.select("file", "row", F.coalesce(at(given), F.lit("")).alias("input"), at(wanted).alias("out"), (F.nullif(strip(at(group)), F.lit("")) if group else F.lit(None).cast("string")).alias("group"))
    output = F.col("out") if task == "json" else strip(F.col("out"))
    problem = F.when(strip(F.col("input")) == "", "empty input").when(F.coalesce(strip(F.col("out")), F.lit("")) == "", "empty output")
    if task == "json":
        value = F.try_parse_json("out")
        problem = problem.when(value.isNull(), "not JSON").when(~F.startswith(F.ltrim("out"), F.lit("{")), "not an object")
    if task == "classification":
        problem = problem.when(F.length(output) > LABEL_CHARS, "long label")
    judged = rows.select("file", "row", "input", output.alias("output"), "group", problem.alias("problem"))
    issues = judged.filter("problem is not null").select("file", F.concat(F.lit("row "), F.col("row").cast("string")).alias("where"), "problem")
    return judged.filter("problem is null").drop("problem"), header.unionAll(issues)


def _kind(v: Column) -> Column:
    """JSON kind of a VARIANT as Spark names it; null if it isn't there."""
    return F.when(v.isNotNull(), F.schema_of_variant(v))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def messages_problem(v: Column) -> Column:
    """What is wrong with a VARIANT that should be a list of messages; null if nothing is."""
    each = F.try_variant_get(v, "$", "array<variant>")
    roles = F.array(*map(F.lit, chat.ROLES))
    text = lambda m, key: F.try_variant_get(m, f"$.{key}", "string")
    is_text = lambda m, key: F.coalesce(_kind(_at(m, f"$.{key}")) == "STRING", F.lit(False))
    weight = lambda m: _at(m, "$.weight").isNull() | F.coalesce(_kind(_at(m, "$.weight")).isin("BIGINT", "DECIMAL(1,0)", "DECIMAL(2,1)") & F.try_variant_get(m, "$.weight", "double").isin(0.0, 1.0), F.lit(False))
    return (
        F.when(each.isNull() | (F.size(each) == 0), "messages must be a list that is not empty")
        .when(F.exists(each, lambda m: ~F.startswith(F.coalesce(_kind(m), F.lit("")), F.lit("OBJECT"))), "a message must be an object")
        .when(F.exists(each, lambda m: ~(is_text(m, "role") & F.array_contains(roles, text(m, "role")))), "unknown role")
        .when(F.exists(each, lambda m: ~is_text(m, "content")), "content must be text")
        .when(F.exists(each, lambda m: ~weight(m)), "weight must be 0 or 1")
        .when(~F.exists(each, lambda m: text(m, "role") == "user"), "no user message")
    )


def line_problem(value: Column) -> Column:
    """What is wrong with a JSON line of the plain, batch or chat shape; null for a good one."""
    v = F.try_parse_json(value)
    kind = lambda path: F.coalesce(_kind(_at(v, path)), F.lit(""))
    has = lambda key: F.array_contains(F.json_object_keys(value), key)
    more = F.array_except(F.json_object_keys(value), F.array(*map(F.lit, PLAIN_FIELDS)))
    plain = (
        F.when(F.size(more) > 0, F.concat(F.lit("unknown fields "), F.array_join(F.array_sort(more), ", ")))
        .when((kind("$.prompt") != "STRING") | (F.coalesce(strip(F.try_variant_get(v, "$.prompt", "string")), F.lit("")) == ""), "prompt must be text")
        .when(has("answer") & has("expected"), "answer and expected in one row")
        .when(has("answer") & (kind("$.answer") != "STRING"), "answer must be text")
        .when(has("system") & (kind("$.system") != "STRING"), "system must be text")
    )
    system = F.when(has("system") & ~kind("$.system").isin("STRING", "VOID"), "system must be text")
    most = F.try_variant_get(v, "$.body.max_tokens", "long")
    batch = (
        F.when((kind("$.custom_id") != "STRING") | (F.try_variant_get(v, "$.custom_id", "string") == ""), "no custom_id")
        .when(~F.startswith(kind("$.body"), F.lit("OBJECT")), "body must be an object")
        .when(messages_problem(_at(v, "$.body.messages")).isNotNull(), messages_problem(_at(v, "$.body.messages")))
        .when(~kind("$.body.max_tokens").isin("", "VOID") & ((kind("$.body.max_tokens") != "BIGINT") | (most < 1)), "max_tokens must be a positive whole number")
        .otherwise(system)
    )
    talk = F.when(messages_problem(_at(v, "$.messages")).isNotNull(), messages_problem(_at(v, "$.messages"))).when(has("custom_id") & (kind("$.custom_id") != "STRING"), "custom_id must be text").otherwise(system)
    return (
        F.when(v.isNull(), "invalid JSON")
        .when(~F.startswith(F.ltrim(value), F.lit("{")), "not an object")
        .when(has("prompt") & ~has("body") & ~has("messages"), plain)
        .when(has("body"), batch)
        .when(has("messages"), talk)
        .otherwise("no shape")
    )


def prompt_rows(lines: DataFrame, value: str, ordinal: str, mode: str = "generate") -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of JSON lines: id, messages, target, max_tokens, expected. Blank lines don't count. An
    id is the line's own or made of its number; the second line of an id is refused, and in ``score`` mode a
    line without an answer after a user's message."""
    from ..sources import files

    v = F.col(value)
    lines = lines.filter(F.coalesce(strip(v), F.lit("")) != "").withColumn("problem", line_problem(v))
    good = lines.filter("problem is null").withColumn("messages", files.line_messages(v))
    system = F.get_json_object(v, "$.system")
    head = F.array(F.struct(F.lit("system").alias("role"), system.alias("content"), F.lit(None).cast("int").alias("weight")))
    good = good.withColumn("messages", F.when((F.coalesce(system, F.lit("")) != "") & (F.get("messages", F.lit(0))["role"] != "system"), F.concat(head, "messages")).otherwise(F.col("messages")))
    made = chat.batch_rows(good, ordinal) if mode == "generate" else good.withColumn("custom_id", F.format_string("row-%06d", F.col(ordinal))).withColumn("target", F.lit(None).cast("string"))
    own = F.nullif(F.get_json_object(v, "$.custom_id"), F.lit(""))
    most = F.coalesce(F.get_json_object(v, "$.body.max_tokens"), F.get_json_object(v, "$.max_tokens")).cast("int")
    made = made.withColumn("custom_id", F.coalesce(own, "custom_id")).withColumn("max_tokens", F.coalesce(most, F.lit(chat.DEFAULT_MAX_TOKENS))).withColumn("expected", F.get_json_object(v, "$.expected"))
    first = made.groupBy("custom_id").agg(F.min(ordinal).alias("first_"))
    made = made.join(first, "custom_id")
    late = F.when(F.col(ordinal) > F.col("first_"), "duplicate custom_id")
    if mode == "score":
        late = F.when((F.try_element_at("messages", F.lit(-1))["role"] != "assistant") | (F.size("messages") < 2), "no target").otherwise(late)
    made = made.withColumn("problem", late)
    issues = lines.filter("problem is not null").select(ordinal, "problem").unionAll(made.filter("problem is not null").select(ordinal, "problem"))
    return made.filter("problem is null").select(ordinal, "custom_id", "messages", "target", "max_tokens", "expected"), issues


def answer_rows(records: DataFrame) -> DataFrame:
    """Chat rows of distillation records (messages, completion or target, error): the answer without white
    space at its ends as the last message. Records with an error or a blank answer are left out."""
    answer = strip(F.col("answer"))
    good = records.filter(F.col("error").isNull() & (F.coalesce(answer, F.lit("")) != ""))
    last = F.struct(F.lit("assistant").alias("role"), answer.alias("content"))
    return good.withColumn("messages", F.concat("messages", F.array(last)))


def training_problem(messages: Column, weight: str = "weight") -> Column:
    """What keeps messages from being trained on; null if nothing does."""
    talk = F.filter(messages, lambda m: m["role"] != "system")
    return (
        F.when(F.try_element_at(messages, F.lit(-1))["role"] != "assistant", "the last message is no answer")
        .when(F.coalesce(F.get(talk, F.lit(0))["role"] != "user", F.lit(True)), "the first message is no user's")
        .when(F.exists(messages, lambda m: m[weight].isNotNull() & (m["role"] != "assistant")), "weight on another role")
        .when(~F.exists(messages, lambda m: (m["role"] == "assistant") & (F.coalesce(m[weight], F.lit(1)) != 0)), "nothing to train on")
    )


def teacher_problem(ids: Column, top_ids: Column, top_lps: Column) -> Column:
    """What is wrong with a teacher's arrays: one list for each token, all of one length; null if they fit."""
    n = F.size(ids)
    sizes = F.array_distinct(F.concat(F.transform(top_ids, F.size), F.transform(top_lps, F.size)))
    return F.when((F.coalesce(n, F.lit(0)) < 1) | ~F.size(top_ids).eqNullSafe(n) | ~F.size(top_lps).eqNullSafe(n), "lengths differ").when(F.size(sizes) != 1, "top-k differs")


def training_rows(rows: DataFrame, answers: DataFrame, vocabulary: Sequence[str] | None = None) -> DataFrame:
    """Training rows with what becomes of each teacher's answer: id, target, fate (used, blank, outside).

    With a vocabulary an answer is a label in its own spelling or else outside; without, the answer
    without white space at its ends. A row that has no answer is blank."""
    both = rows.join(answers.select("id", "answer"), "id", "left")
    text = strip(F.col("answer"))
    if vocabulary is None:
        target, outside = text, F.lit(False)
    else:
        known = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in vocabulary], "label string").select(normalized(F.col("label")).alias("norm_"), F.col("label").alias("label_")))
        both = both.withColumn("norm_", normalized(F.col("answer"))).join(known, "norm_", "left")
        target, outside = F.col("label_"), F.col("label_").isNull()
    fate = F.when(F.coalesce(text, F.lit("")) == "", "blank").when(outside, "outside").otherwise("used")
    return both.withColumn("fate", fate).withColumn("target", F.when(F.col("fate") == "used", target)).select(*rows.columns, "target", "fate")


def resolved_split(rows: DataFrame, components: DataFrame, seed: str, test: float, val: float) -> DataFrame:
    """(id, split, mode) of rows whose ``given`` split is train, val, test or null for train.

    With val and test both supplied they are kept. With one, the other is dealt from the other rows in whole
    components until it has its share of all rows; with none, both are. ``components`` is (id, component)."""
    from . import splits

    given = {r["given"] for r in rows.select("given").filter("given in ('val', 'test')").distinct().collect()}
    if len(given) == 2:
        return rows.select("id", F.coalesce("given", F.lit("train")).alias("split"), F.lit("supplied").alias("mode"))
    free = rows.filter("given is null or given = 'train'").join(components, "id")
    if not given:
        dealt = splits.deal(free, seed, test, val).select("component", "split")
        return free.join(dealt, "component").select("id", "split", F.lit("generated").alias("mode"))
    kept = given.pop()
    wanted, share = ("val", val) if kept == "test" else ("test", test)
    total = rows.count()
    own = free.count()
    goal = round(total * share)
    dealt = splits.deal(free, seed, goal / own if own else 0.0, 0.0).select("component", F.when(F.col("split") == "test", wanted).otherwise("train").alias("split"))
    out = free.join(dealt, "component").select("id", "split")
    return out.unionAll(rows.filter(F.col("given") == kept).select("id", F.lit(kept).alias("split"))).withColumn("mode", F.lit("mixed"))


def size_problems(counts: DataFrame, task: str) -> DataFrame:
    """Why a split cannot be built on: rows of (problem) from one row (n_train, n_val, n_labels)."""
    found = F.array(
        F.when(F.col("n_train") < LEAST_TRAIN, F.lit("few training rows")),
        F.when(F.col("n_val") < LEAST_VAL, F.lit("few validation rows")),
        F.when((F.col("n_train") > 0) & (F.col("n_labels") < 2), F.lit("fewer than two classes")) if task in ("classification", "exact") else F.lit(None).cast("string"),
    )
    return counts.select(F.explode(F.array_compact(found)).alias("problem"))


def split_digest(rows: DataFrame, by: str, order: Sequence[str], line: Column, ranges: int = 256) -> DataFrame:
    """Digest of a split's lines in order: sha256 of the digests of the lines, in two steps, so that no task
    holds more than a range of a split's rows. Rows are dealt to ranges by the order of their number."""
    place = rows.withColumn("line_", F.sha2(line, 256)).withColumn("range_", F.left(F.sha2(F.concat_ws(chr(0), *order), 256), F.lit(2)))
    part = place.groupBy(by, "range_").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line_")), ""), 256).alias("part_"), F.count("*").alias("n_"))
    return part.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_", "part_"))), lambda x: x["part_"]), ""), 256).alias("digest"), F.sum("n_").alias("n"))


def short_expected(rows: DataFrame, expected: str) -> DataFrame:
    """Whether every expected value is short (at most 64 characters and 8 words), and the max_tokens that
    the longest takes: a quarter of its characters and four, 16 at least."""
    text = F.coalesce(F.col(expected), F.lit(""))
    short = F.col(expected).isNotNull() & (F.length(text) <= 64) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) <= 8)
    longest = F.coalesce(F.max(F.length(text)), F.lit(0))
    return rows.agg((F.coalesce(F.bool_and(short), F.lit(False))).alias("classification"), F.greatest(F.lit(16), F.ceil(longest / 4) + 4).cast("int").alias("max_tokens"))


def common_prefix(rows: DataFrame, text: str) -> DataFrame:
    """The longest prefix that all texts share: that of the least and the greatest. Nulls don't count."""
    ends = rows.agg(F.min(text).alias("a"), F.max(text).alias("b"))
    n = F.least(F.length("a"), F.length("b"))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.left("a", k) == F.left("b", k))
    return ends.select(F.left("a", F.array_max(same)).alias("prefix"))


def prompt_view(text: Column, system: str | None, contract: str = "") -> Column:
    """Messages of a prompt: system and contract as one system message where there are any, then the user's."""
    head = "\n\n".join(x for x in (system, contract) if x)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(*([message("system", F.lit(head))] if head else []), message("user", text))


def label_contract(labels: Sequence[str]) -> str:
    """What an untrained model is told of a classification; fixed text."""
    return "Classify the input into exactly one of these labels. Reply with the label only, spelled exactly as listed.\nLabels: " + ", ".join(labels)


def request_rows(rows: DataFrame, messages: Column, expected: Column, max_tokens: int, decoding: dict | None = None) -> DataFrame:
    """Batch requests with every decoding setting in the body: greedy unless told otherwise."""
    d = {"temperature": 0.0, "top_p": 1.0, "stop": [], "seed": 0, "greedy": True} | (decoding or {})
    stop = F.array(*map(F.lit, d["stop"])).cast("array<string>")
    body = F.struct(messages.alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(float(d["temperature"])).alias("temperature"), F.lit(float(d["top_p"])).alias("top_p"), stop.alias("stop"), F.lit(int(d["seed"])).alias("seed"), F.lit(bool(d["greedy"])).alias("greedy"))
    return rows.select(F.col("id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"), expected.alias("expected"))


def decoding_problems(body: Column) -> Column:
    """Settings of a request that a greedy engine cannot apply, as an array of their names."""
    return F.array_compact(
        F.array(
            F.when(body["temperature"].isNotNull() & (body["temperature"] != 0), "temperature"),
            F.when(body["top_p"].isNotNull() & (body["top_p"] != 1), "top_p"),
            F.when(F.size(body["stop"]) > 0, "stop"),
            F.when(~body["greedy"], "greedy"),
        )
    )


def for_role(messages: Column, system: str | None, drop_answer: bool = False) -> Column:
    """Messages for a role: a text before the system message's own, or as one; on demand without an answer
    at the end."""
    m = F.when(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.slice(messages, 1, F.greatest(F.lit(0), F.size(messages) - 1))).otherwise(messages) if drop_answer else messages
    if not system:
        return m
    head = F.get(m, F.lit(0))
    rest = F.slice(m, 2, F.greatest(F.lit(0), F.size(m) - 1))
    merged = F.array(head.withField("content", F.concat(F.lit(system + "\n\n"), head["content"])))
    return F.when(head["role"] == "system", F.concat(merged, rest)).otherwise(chat.with_system(m, F.lit(system)))


def declared_labels(text: str) -> list[str]:
    """Labels of a comma list or of lines; two at least, none twice."""
    labels = [x.strip() for x in text.replace("\n", ",").split(",") if x.strip()]
    if len(set(labels)) != len(labels):
        raise ValueError("a label stands twice")
    if len(labels) < 2:
        raise ValueError("two labels at least")
    return labels


def ordered_distinct(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Distinct values in the order of their first row: the values and ``first``."""
    return rows.groupBy(*by).agg(F.min(order).alias("first"))


def target_text(task: str, output: Column) -> Column:
    """What a row is trained to say: text as it is, a JSON task's record in canonical form."""
    from ..functions.jsontools import canonical_json

    return canonical_json(output) if task == "json" else output


def training_file(lines: DataFrame, value: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of a training file of plain, chat or distillation lines: messages that end with an
    answer. Records with an error or a blank answer are left out without an issue."""
    from ..sources import files

    v = F.col(value)
    get = lambda key: F.get_json_object(v, f"$.{key}")
    record = get("teacher").isNotNull() & get("messages").isNotNull() & (get("completion").isNotNull() | get("target").isNotNull())
    lines = lines.filter(F.coalesce(strip(v), F.lit("")) != "").withColumn("record_", F.coalesce(record, F.lit(False))).withColumn("problem", line_problem(v))
    taught = lines.filter("record_ and problem is null").select(ordinal, files.line_messages(v).alias("messages"), F.coalesce(get("completion"), get("target")).alias("answer"), get("error").alias("error"))
    last = F.struct(F.lit("assistant").alias("role"), strip(F.col("answer")).alias("content"), F.lit(None).cast("int").alias("weight"))
    taught = taught.filter("error is null").filter(strip(F.col("answer")) != "").select(ordinal, F.concat("messages", F.array(last)).alias("messages"))
    plain = lines.filter("not record_ and problem is null").select(ordinal, files.line_messages(v).alias("messages"))
    plain = plain.withColumn("problem", F.when(F.try_element_at("messages", F.lit(-1))["role"] != "assistant", "no answer"))
    issues = lines.filter("problem is not null").select(ordinal, "problem").unionAll(plain.filter("problem is not null").select(ordinal, "problem"))
    return taught.unionByName(plain.filter("problem is null").drop("problem")), issues


def file_summary(lines: DataFrame, value: str, ordinal: str, by: str) -> DataFrame:
    """One row a file (``by``): rows, shape, use, expected, targets, and what is wrong with the whole file:
    lines of two shapes, records of distillation among others, or expected values or targets on some rows
    only. Lines that are wrong by themselves are counted as ``issues``; blank lines are not counted."""
    from ..sources import files

    v = F.col(value)
    lines = lines.filter(F.coalesce(strip(v), F.lit("")) != "")
    get = lambda key: F.get_json_object(v, f"$.{key}").isNotNull()
    record = F.coalesce(get("teacher") & get("messages") & (get("completion") | get("target")), F.lit(False))
    good = line_problem(v).isNull()
    shaped = lines.select(by, good.alias("good"), F.when(good, F.when(record, "distill").otherwise(files.line_shape(v))).alias("shape"), (good & get("expected")).alias("expected"), F.coalesce(good & (record | (F.try_element_at(files.line_messages(v), F.lit(-1))["role"] == "assistant")), F.lit(False)).alias("target"))
    out = shaped.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_if(~F.col("good")).alias("issues"), F.array_join(F.array_sort(F.collect_set("shape")), ",").alias("shape"), F.count_if("expected").alias("expected"), F.count_if("target").alias("targets"))
    some = lambda c: (F.col(c) > 0) & (F.col(c) < F.col("n_rows"))
    use = F.when(F.col("shape") == "distill", "distillation records").when(F.col("expected") > 0, "eval").when(F.col("targets") > 0, "train").otherwise("prompts")
    problem = F.when(F.col("issues") > 0, "lines with issues").when(F.contains("shape", F.lit(",")), "mixed shapes").when(some("expected"), "expected on some rows").when(some("targets"), "targets on some rows")
    return out.withColumn("use", use).withColumn("problem", problem)


def json_columns(lines: DataFrame, value: str, ordinal: str) -> DataFrame:
    """(key, place) of the keys of JSON objects in the order in which they are first seen."""
    keys = lines.select(ordinal, F.posexplode(F.json_object_keys(F.col(value))).alias("at", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct(ordinal, "at")).alias("first"))
    return first.select("key", F.col(f"first.{ordinal}").alias("line"), F.col("first.at").alias("at"))
