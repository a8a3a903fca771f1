"""Row scorers as columns: 1.0 or 0.0, null where a row has nothing to score."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .jsontools import json_field
from .text import normalized, strip, words


def _unit(c: Column) -> Column:
    return c.cast("double")


def exact_match(text: Column, options: Column) -> Column:
    """The stripped text equals any of the options; null text scores null."""
    return F.when(text.isNotNull(), _unit(F.exists(options, lambda o: strip(o) == strip(text))))


def contains_all(text: Column, needles: Column) -> Column:
    """Every needle is in the text, in any case."""
    return F.when(text.isNotNull(), _unit(F.forall(needles, lambda n: F.contains(F.lower(text), F.lower(n)))))


def regex_found(text: Column, pattern: Column) -> Column:
    """The pattern is found anywhere; a dot matches line ends too."""
    return F.when(text.isNotNull(), _unit(F.regexp(text, F.concat(F.lit("(?s)"), pattern))))


#: How numbers, scores and picks are written in a judge's reply.
UNIT_NUMBER = r"(?<![\d.])(1(?:\.0+)?|0(?:\.\d+)?|\.\d+)(?![\d.])"
SCORE = r"(?i)score\s*[:=\-]?\s*\**\s*([1-5])(?!\d)"
PICK = r"(?i)better\s*[:=\-]?\s*\**\s*(?:answer\s*)?(a|b|tie)\b"
RATIONALE = r"(?is)rationale\s*[:=\-]?\s*(.*?)(?:\n\s*(?:score|better)\b|$)"
RATIONALE_CHARS = 600


def parse_json_loose(text: Column) -> Column:
    """VARIANT of a fenced block, the whole text, or the first braced or bracketed span; null if none."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)```", 1)
    span = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    listed = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    tried = [F.try_parse_json(F.when(strip(x) != "", strip(x))) for x in (fence, text, span, listed)]
    return F.coalesce(*tried)


def parse_json_strict(text: Column) -> Column:
    """VARIANT of one JSON value, stripped and out of at most one fence; null if it is anything else."""
    bare = F.regexp_replace(strip(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    return F.try_parse_json(F.when(bare != "", bare))


def unit_score(reply: Column) -> Column:
    """The first number from 0 to 1 of a reply, not part of a longer number; null if none."""
    found = F.regexp_extract(reply, UNIT_NUMBER, 1)
    return F.when(found != "", found.cast("double"))


def rationale(reply: Column) -> Column:
    """What a reply gives as its reason, else all of it, without white space at the ends, up to 600
    characters; empty for no reply."""
    named = F.when(F.regexp(reply, F.lit(r"(?i)rationale")), F.regexp_extract(reply, RATIONALE, 1)).otherwise(reply)
    return F.coalesce(F.left(strip(named), F.lit(RATIONALE_CHARS)), F.lit(""))


def pointwise_score(reply: Column) -> Column:
    """The last score from 1 to 5 that a reply names; null if none."""
    return F.try_element_at(F.regexp_extract_all(reply, F.lit(SCORE), F.lit(1)), F.lit(-1)).cast("int")


def pairwise_pick(reply: Column) -> Column:
    """The last pick of A, B or tie that a reply names; null if none."""
    pick = F.try_element_at(F.regexp_extract_all(reply, F.lit(PICK), F.lit(1)), F.lit(-1))
    return F.when(F.lower(pick) == "tie", "tie").otherwise(F.upper(pick))


def judge_messages(rubric: Column, prompt: Column, expected: Column, response: Column) -> Column:
    """The two messages that ask a judge for a number from 0 to 1. ``prompt`` is an array of (role,
    content); the template is a fixed value."""
    asked = F.array_join(F.transform(prompt, lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["content"])), "\n")
    user = F.format_string("%s\n\nPROMPT:\n%s\n\nEXPECTED:\n%s\n\nRESPONSE:\n%s\n\nScore (0 to 1):", rubric, asked, expected, F.coalesce(response, F.lit("")))
    system = F.lit("You are a strict grader. Reply with one number between 0 and 1 and nothing else.")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", system), message("user", user))


def script_metric(path: str):
    """UDF of a user's file that defines ``score(row) -> float | None``: held to 0..1, null where the row
    has no text. It takes (custom_id, text, expected); the file is read once on the driver and sent along."""
    from pathlib import Path

    code = Path(path).read_text(encoding="utf-8")

    @pandas_udf(T.DoubleType())
    def score(custom_id: pd.Series, text: pd.Series, expected: pd.Series) -> pd.Series:
        names: dict = {"__name__": "metric"}
        exec(compile(code, path, "exec"), names)  # noqa: S102  the user's own file
        if not callable(names.get("score")):
            raise ValueError(f"{path} must define score(row)")

        def one(i, t, e):
            if t is None:
                return None
            v = names["score"]({"custom_id": i, "text": t, "expected": e})
            return None if v is None else max(0.0, min(1.0, float(v)))

        return pd.Series([one(*row) for row in zip(custom_id, text, expected, strict=True)], dtype="float64")

    return score


def project_script(path: str):
    """UDF of a project's file that defines ``score({id, input, gold, text, pred}) -> float``: not held to
    any range; an exception stops the job and names the row."""
    from pathlib import Path

    code = Path(path).read_text(encoding="utf-8")

    @pandas_udf(T.DoubleType())
    def score(id: pd.Series, input: pd.Series, gold: pd.Series, text: pd.Series, pred: pd.Series) -> pd.Series:
        names: dict = {"__name__": "scoring"}
        exec(compile(code, path, "exec"), names)  # noqa: S102  the user's own file
        out = []
        for row in zip(id, input, gold, text, pred, strict=True):
            try:
                out.append(float(names["score"](dict(zip(("id", "input", "gold", "text", "pred"), row, strict=True)))))
            except Exception as e:
                raise ValueError(f"the scoring script failed on row {row[0]}: {e}") from e
        return pd.Series(out, dtype="float64")

    return score


def to_model(pick: Column, first: Column, second: Column) -> Column:
    """The model behind a pick by position."""
    return F.when(pick == "A", first).when(pick == "B", second).when(pick == "tie", F.lit("tie"))


def combined_orders(one: Column, other: Column) -> tuple[Column, Column]:
    """(verdict, disagreed) of both presentation orders: the same twice is the verdict, else a tie; null
    where a reply is missing."""
    both = one.isNotNull() & other.isNotNull()
    return F.when(both, F.when(one == other, one).otherwise(F.lit("tie"))), F.when(both, one != other)


@pandas_udf(T.IntegerType())
def bag_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Elements that two arrays have in common as bags; 0 for a null array."""
    one = lambda x, y: 0 if x is None or y is None else (Counter(x) & Counter(y)).total()
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def token_f1(text: Column, reference: Column) -> Column:
    """2 * overlap / (words of both) on bags of words; 0 without any overlap or without a text."""
    a, b = words(text), words(reference)
    overlap = bag_overlap(a, b)
    return F.when(overlap > 0, 2.0 * overlap / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


@pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays: bit-parallel, a word of the first array's
    length for each element of the second. A null array has length 0 in common with any."""

    def one(x, y) -> int:
        if x is None or y is None or not len(x):
            return 0
        at: dict = {}
        for i, w in enumerate(x):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(x)) - 1
        v = full
        for w in y:
            u = v & at.get(w, 0)
            v = (v + u | v - u) & full
        return len(x) - v.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(text: Column, reference: Column) -> Column:
    """2 * LCS / (words of both); 0 if either has no words."""
    a, b = words(text), words(reference)
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * lcs_length(a, b) / total).otherwise(F.lit(0.0))


def reference_in_output(reference: Column, output: Column) -> Column:
    """The reference's words stand in the output in one run."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    return F.contains(pad(output), pad(reference))


def checkable(reference: Column, most: int = 5) -> Column:
    return F.size(words(reference)).between(1, most)


def score_class(text: Column, gold: Column, labels: list[str]) -> tuple[Column, Column]:
    """(predicted label in normal form or null, correct): an output is valid if it is a label in normal form."""
    known = F.array(*(normalized(F.lit(x)) for x in sorted(labels)))
    pred = F.when(F.array_contains(known, normalized(text)), normalized(text))
    return pred, F.coalesce(pred == normalized(gold), F.lit(False))


def response_text(row: Column) -> Column:
    """The answer in a result row, null on an error row."""
    return F.when(row.getField("error").isNull(), row.getField("response").getField("body").getField("choices")[0].getField("message").getField("content"))


#: Metrics by name, as columns of (text, expected).
METRICS = {"exact_match": exact_match, "contains": contains_all, "regex": regex_found, "json_field": json_field, "token_f1": token_f1, "rouge_l": rouge_l}


def metric(name: str):
    """The metric of a name; ``script:path.py`` is a user's file."""
    if name.startswith("script:"):
        return script_metric(name.removeprefix("script:"))
    if name not in METRICS:
        raise ValueError(f"no metric {name!r}: {', '.join(sorted(METRICS))} or script:path.py")
    return METRICS[name]
