"""Chat rows: building, checking, truncating and batching conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
DEFAULT_MAX_TOKENS = 128


def messages(turns: DataFrame, key: str, order: str) -> DataFrame:
    """One row a conversation with its messages in order."""
    m = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "role", F.col("text").alias("content"))))
    rows = turns.groupBy(key).agg(m.alias("m"))
    return rows.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def valid(m: Column) -> Column:
    """A non-empty list of known roles with text and at least one user."""
    known = F.array(*map(F.lit, ROLES))
    return (F.size(m) > 0) & F.forall(m, lambda x: F.array_contains(known, x["role"]) & x["content"].isNotNull()) & F.exists(m, lambda x: x["role"] == "user")


def with_system(m: Column, text: Column) -> Column:
    """A system message first, unless there is one."""
    first = F.array(F.struct(F.lit("system").alias("role"), text.alias("content")))
    return F.when(F.get(m, F.lit(0))["role"] == "system", m).otherwise(F.concat(first, m))


def batch_rows(rows: DataFrame, ordinal: str) -> DataFrame:
    """Default id by line number; an assistant's last message becomes the target; default max_tokens."""
    last = F.try_element_at("messages", F.lit(-1))
    answered = last["role"] == "assistant"
    out = rows.withColumn("custom_id", F.format_string("row-%06d", F.col(ordinal)))
    out = out.withColumn("target", F.when(answered, last["content"]))
    return out.withColumn("messages", F.when(answered, F.slice("messages", 1, F.greatest(F.lit(0), F.size("messages") - 1))).otherwise(F.col("messages"))).withColumn("max_tokens", F.lit(DEFAULT_MAX_TOKENS))


def truncated(turns: DataFrame, key: str, order: str, tokens: str, most: int) -> DataFrame:
    """Turns that stay when whole exchanges are dropped from the left until at most ``most`` tokens are
    left; system turns stay and count. A conversation whose last exchange is too long is skipped.

    An exchange starts at a user turn. Columns added: exchange, and kept (null where skipped)."""
    w = Window.partitionBy(key).orderBy(order)
    back = Window.partitionBy(key).orderBy(F.desc("exchange")).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    system = F.col("role") == "system"
    out = turns.withColumn("exchange", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    out = out.withColumn("system_", F.sum(F.when(system, F.col(tokens)).otherwise(0)).over(whole))
    out = out.withColumn("tail_", F.sum(F.when(system, 0).otherwise(F.col(tokens))).over(back))
    out = out.withColumn("last_", F.min(F.when(~system, F.col("tail_"))).over(whole))
    fits = F.col("tail_") + F.col("system_") <= most
    kept = F.when(F.col("last_") + F.col("system_") <= most, system | fits)
    return out.withColumn("kept", kept).drop("system_", "tail_", "last_")


def length_buckets(rows: DataFrame, key: str, length: str, size: int, seed: str, multiple: int = 32) -> DataFrame:
    """Micro-batches of ``size`` rows by length, longest padded to a multiple, in a seeded order.

    The place in the length order is counted in two steps, by length and then within a length, so no task
    holds all rows."""
    lengths = rows.groupBy(length).agg(F.count("*").alias("n_"))
    base = lengths.withColumn("base_", F.sum("n_").over(Window.orderBy(length)) - F.col("n_")).drop("n_")
    placed = rows.withColumn("in_", F.row_number().over(Window.partitionBy(length).orderBy(key))).join(base, length)
    batch = F.floor((F.col("base_") + F.col("in_") - 1) / size).cast("long")
    padded = F.ceil(F.max(length).over(Window.partitionBy("batch")) / multiple) * multiple
    out = placed.withColumn("batch", batch).withColumn("padded", padded.cast("long"))
    return out.withColumn("draw", F.sha2(F.concat(F.lit(seed), F.col("batch").cast("string")), 256)).drop("in_", "base_")


def padded_batch(ids: Column, mask: Column, width: Column, pad: int = 0) -> tuple[Column, Column, Column]:
    """(inputs, targets, mask) of an example for training: targets are the inputs shifted by one, all three
    padded to the width of the batch; what is not trained on is masked with 0."""
    n = F.size(ids) - 1
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("long"), F.greatest(F.lit(0), width - n).cast("int")))
    return fill(F.slice(ids, F.lit(1), n), pad), fill(F.slice(ids, F.lit(2), n), pad), fill(F.slice(mask, F.lit(2), n), 0)


def trainable_left(turns: DataFrame, key: str, weight: str) -> DataFrame:
    """Conversations of truncated turns (kept, role) with whether they can be trained on: an assistant's turn
    with a weight that is not 0 must have stayed. Where dropping turns took the last such turn, or the last
    exchange is too long, the conversation is skipped."""
    trained = (F.col("role") == "assistant") & (F.coalesce(weight, F.lit(1)) != 0)
    return turns.groupBy(key).agg(F.count_if(~F.coalesce("kept", F.lit(True))).alias("dropped"), F.bool_or(F.coalesce(F.col("kept") & trained, F.lit(False))).alias("usable"))
