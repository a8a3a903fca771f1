"""Durations and the arithmetic of cost estimates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Seconds of each unit, and the forms of a timestamp.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
STAMPS = ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def parse_duration(c: Column) -> Column:
    """Seconds of ``1d12h``, ``90m``, ``1.5h``, ``2h 30m 15s``, ``1w``; null if the text is anything else or
    comes to nothing."""
    part = r"(\d+(?:\.\d+)?)\s*([smhdw])"
    numbers = F.regexp_extract_all(F.lower(c), F.lit(part), F.lit(1))
    units = F.regexp_extract_all(F.lower(c), F.lit(part), F.lit(2))
    size = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in (kv[0], float(kv[1]))))
    total = F.aggregate(F.arrays_zip(numbers.alias("n"), units.alias("u")), F.lit(0.0), lambda s, x: s + x["n"].cast("double") * size[x["u"]])
    return F.when(F.lower(c).rlike(rf"^\s*({part}\s*)+$") & (total > 0), total)


def parse_deadline(c: Column, now: Column) -> Column:
    """Seconds from ``now`` of a duration or of a timestamp; null if it is neither or not in the future."""
    stamp = F.coalesce(*(F.when(F.length(F.trim(c)) == len(f.replace("'", "")), F.try_to_timestamp(F.trim(c), F.lit(f))) for f in STAMPS))
    left = stamp.cast("double") - now.cast("double")
    return F.coalesce(parse_duration(c), F.when(left > 0, left))


def format_duration(seconds: Column) -> Column:
    """Seconds under 90, minutes under 90, hours under 48, else days; hours and days with one decimal. Halves
    go by the exact value, to even."""
    s = seconds.cast("double")
    shown = lambda x, f, unit: F.concat(F.call_function("format_number", x, F.lit(f)), F.lit(unit))
    return (
        F.when(s < 90, shown(s, "0", " s"))
        .when(s < 5400, shown(s / 60, "0", " min"))
        .when(s < 48 * 3600, shown(s / 3600, "0.0", " h"))
        .otherwise(shown(s / 86400, "0.0", " days"))
    )


def prefill_seconds(params: Column, tokens: Column, flops: Column) -> Column:
    """Two operations a parameter and token."""
    return 2.0 * params * tokens / flops


def train_seconds(params: Column, tokens: Column, epochs: Column, flops: Column) -> Column:
    """Six operations a parameter and token, each epoch."""
    return 6.0 * params * tokens * epochs / flops


def decode_seconds(rows: Column, batch: Column, out_tokens: Column, pass_seconds: Column) -> Column:
    """A pass over the weights for each output token of each chunk, and one more a chunk."""
    return F.ceil(rows / batch) * (out_tokens + 1) * pass_seconds


def batch_by_memory(budget: Column, per_row: Column, most: Column) -> Column:
    return F.greatest(F.lit(1), F.least(most, F.floor(budget / per_row).cast("long")))


#: Shares of memory and disk that plans may use, and sizes they are made of.
GIB = 1 << 30
MEMORY_SHARE = 0.75
MOST_MICRO_BATCH = 64
HEAD_CHUNK_BYTES = GIB
DISK_FLOOR = 20 * GIB
MOST_JOB_HOURS = 24


def micro_batch(working_set: Column, hidden: Column, inter: Column, layers: Column, vocab: Column, layer_bytes: Column, resident: Column, lora: Column, seq: Column, examples: Column, share: float = MEMORY_SHARE, ring: int = 3, most: int = MOST_MICRO_BATCH) -> Column:
    """Largest micro-batch that fits the share of memory, examples and the most allowed; null if not even
    one fits. Fixed: the ring of layers, what is resident, LoRA with its optimizer, the loss head's chunk.
    A sample: saved activations of all layers, and the buffers of one."""
    div = lambda a, b: F.call_function("div", a.cast("long"), b.cast("long"))
    head = F.greatest(F.lit(64).cast("long"), div(F.lit(HEAD_CHUNK_BYTES), vocab * 12)) * vocab * 12
    fixed = ring * layer_bytes + resident + lora * 4 + head
    saved = seq * hidden * 2 * layers
    work = seq * (2 * (8 * hidden + 4 * inter) + 4 * (6 * hidden + 3 * inter)) + 2 * seq * hidden * 2
    fit = div(F.floor(working_set * share) - fixed, F.greatest(F.lit(1).cast("long"), saved + work))
    return F.when((F.floor(working_set * share) >= fixed) & (fit >= 1), F.least(fit, examples.cast("long"), F.lit(most).cast("long")))


def job_seconds(model_bytes: Column, rows: Column, max_tokens: Column, batch: Column, rate: Column) -> Column:
    """A pass over the weights for each token of each chunk and one to prefill it."""
    return F.ceil(rows / F.greatest(F.lit(1), batch)) * (max_tokens + 1) * model_bytes / rate


def quant_choice(explicit: Column, bf16_here: Column, free: Column, model_bytes: Column, seconds: Column) -> tuple[Column, Column]:
    """(quant, reason): what was asked for, else 8-bit where the disk cannot hold bf16 or the job is too long."""
    full = ~bf16_here & (free - model_bytes < DISK_FLOOR)
    slow = seconds > MOST_JOB_HOURS * 3600
    return F.when(explicit.isNotNull(), explicit).when(full | slow, "8bit").otherwise("bf16"), F.when(explicit.isNotNull(), "explicit").when(full, "disk").when(slow, "time").otherwise("default")


def offload(weights: Column, layers: Column, kv_per_token: Column, ctx: Column, vram: Column, headroom: float = 0.9, weight_share: float = 0.75) -> tuple[Column, Column]:
    """(layers on the device, parallel slots): all layers and the output one where the weights fit their
    share; slots are bound by what is left for keys and values, 256 at most."""
    budget = F.floor(vram * headroom)
    whole = weights <= weight_share * budget
    n = F.when(whole, layers + 1).otherwise(F.greatest(F.lit(1), F.floor(weight_share * budget / (weights / layers)))).cast("long")
    used = F.when(whole, weights).otherwise(F.floor(n * (weights / layers)))
    slots = F.floor((budget - used) / (kv_per_token * ctx))
    return n, F.least(F.lit(256), F.greatest(F.lit(1), slots)).cast("long")


def steps(micro_batches: Column, accumulate: Column, epochs: Column) -> Column:
    """Optimizer steps: whole groups of micro-batches, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.floor(micro_batches * epochs) / F.greatest(F.lit(1), accumulate)).cast("long"))


def disk_needs(lora_params: Column, base_bytes: Column, rows: Column, epochs: Column, step_rows: Column, every: Column) -> tuple[Column, Column, Column]:
    """(checkpoints, bytes of them, bytes of the adapter): twelve bytes a parameter in a checkpoint, four in
    an adapter."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1), F.ceil(rows * epochs / step_rows)) / every)).cast("long")
    return n, n * lora_params * 12, lora_params * 4


def memory_path(size: Column, working_set: Column, forced: Column, share: float = 0.35) -> Column:
    """resident or streamed: as forced, else by whether the weights fit the share of memory."""
    return F.when(forced.isin("resident", "streamed"), forced).when(size <= share * working_set, "resident").otherwise("streamed")


def distill_loss(wanted: Column, teacher: Column, student_tokenizer: Column, teacher_tokenizer: Column) -> Column:
    """ce without a teacher; auto is mix with one tokenizer and else ce; kl and mix need one tokenizer and are
    null (refused) without."""
    match = F.coalesce(student_tokenizer == teacher_tokenizer, F.lit(False))
    auto = F.when(match, "mix").otherwise("ce")
    return F.when(teacher.isNull(), "ce").when(wanted == "auto", auto).when(wanted.isin("kl", "mix") & ~match, None).otherwise(wanted)


def roles(task: Column, teacher: Column, judge: Column, metric: Column) -> tuple[Column, Column]:
    """(judge, metric): an open task's teacher judges unless a judge or ``none`` is named, and a judge makes
    its score the metric. The rule changes nothing when it is used again."""
    named = F.when(F.coalesce(judge, F.lit("")) != "", judge).otherwise(F.nullif(teacher, F.lit("")))
    judge_ = F.when(task == "open", named).otherwise(judge)
    has = judge_.isNotNull() & (judge_ != "none") & (judge_ != "")
    metric_ = F.when((task == "open") & has & (metric == "token_f1"), "judge_mean").when((task == "open") & ~has & (metric == "judge_mean"), "token_f1").otherwise(metric)
    return judge_, metric_


def judge_requests_count(rows: Column, judged: Column, pairs: Column) -> Column:
    return rows * (judged + 2 * pairs)


#: The metrics of each task, and those that any task may have.
TASK_METRICS = {"classification": ("accuracy", "macro_f1"), "json": ("whole_record_accuracy", "mean_field_accuracy", "parseable_rate", "schema_valid_rate"), "open": ("token_f1", "rouge_l", "exact_match", "judge_mean")}
ANY_METRICS = ("script_score",)


def metric_fits(task: Column, metric: Column) -> Column:
    """Whether a task knows a metric."""
    own = F.lit(False)
    for name, known in TASK_METRICS.items():
        own = own | (task == name) & metric.isin(*known, *ANY_METRICS)
    return own


def overnight_seconds(params_b: Column, rate: Column, working_set: Column, tflops: Column, resident_rate: float) -> Column:
    """Seconds of the reference job: 2,000 rows of 300 tokens with 64 new ones each, on a bf16 model of so
    many billion parameters. Weights within 70% of memory are read at ``resident_rate``, else from disk, once
    a pass; the batch is what the keys and values of a row leave room for, 512 at most."""
    size = params_b * 2e9
    kv = 2 * F.greatest(F.lit(8), F.floor(F.sqrt(params_b) * 3)) * 8 * 128 * 2
    inside = size <= working_set * 0.70
    room = F.greatest(working_set * 0.75 - F.when(inside, size).otherwise(8e9), F.lit(1e9))
    batch = F.greatest(F.lit(1), F.least(F.lit(512), F.floor(room / (364 * kv))))
    passes = F.ceil(2000 / batch) * 65
    return passes * size / F.when(inside, F.lit(resident_rate)).otherwise(rate) + 2 * params_b * 1e9 * 2000 * 300 / (tflops * 1e12)


def largest_overnight(machines, resident_rate: float, hours: float = 12.0):
    """Machines (rate, working_set, free_disk, tflops) with the most whole billions of parameters, under 400,
    whose weights leave the disk its floor and whose reference job ends in time, and what sets the limit."""
    own = machines.columns
    tried = machines.withColumn("p_", F.explode(F.sequence(F.lit(1), F.lit(399))))
    full = F.col("p_") * 2e9 + DISK_FLOOR > F.col("free_disk")
    late = overnight_seconds(F.col("p_"), F.col("rate"), F.col("working_set"), F.col("tflops"), resident_rate) > hours * 3600
    stop = F.min(F.when(full | late, F.struct(F.col("p_"), F.when(full, "disk").otherwise("time").alias("limit"))))
    out = tried.groupBy(*own).agg(stop.alias("stop_"))
    return out.select(*own, F.coalesce(F.col("stop_.p_") - 1, F.lit(399)).alias("billions"), F.coalesce("stop_.limit", F.lit("time")).alias("limit"))


#: The smallest judge in billions of parameters, and the share of memory that its weights may take.
LEAST_JUDGE, JUDGE_SHARE = 1.5, 0.6


def recommended(machines, candidates: list[tuple[str, float]]):
    """Machines (memory, student) with ``judge``: of the candidates (name, billions of parameters) the largest
    that is no less than the smallest judge, not the student, and fits its share of memory at two bytes a
    parameter; else the smallest judge."""
    own = machines.columns
    fits = [F.when((F.lower("student") != name.lower()) & (F.lit(b * 2e9) <= JUDGE_SHARE * F.col("memory")), F.lit(name)) for name, b in sorted(candidates, key=lambda c: -c[1]) if b >= LEAST_JUDGE]
    smallest = min((c for c in candidates if c[1] >= LEAST_JUDGE), key=lambda c: c[1])[0]
    return machines.select(*own, F.coalesce(*fits, F.lit(smallest)).alias("judge"))
