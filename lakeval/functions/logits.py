"""Log-probabilities of vectors of logits, as columns: the maximum and the normaliser are worked out once a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _with(value: Column, use) -> Column:
    """``use`` of a value that stands for itself in every lambda inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _normalised(l: Column, use) -> Column:
    top = _with(F.struct(l.alias("l"), F.array_max(l).alias("m")), lambda s: F.struct(s["l"].alias("l"), (s["m"] + F.log(F.aggregate(s["l"], F.lit(0.0), lambda a, v: a + F.exp(v - s["m"])))).alias("z")))
    return _with(top, use)


def log_softmax(l: Column) -> Column:
    """Array of log-probabilities; null for a null or empty array."""
    return F.when(F.size(l) > 0, _normalised(l, lambda s: F.transform(s["l"], lambda v: v - s["z"])))


def token_logprob(l: Column, token: Column) -> Column:
    """Log-probability of the token at a position from 0; null outside the array."""
    return F.when(F.size(l) > 0, _normalised(l, lambda s: F.get(s["l"], token) - s["z"]))


def top_tokens(l: Column, k: int) -> Column:
    """The ``k`` likeliest (token, logprob), likeliest first, ties (to nine decimals) by token. The array is
    sorted once: V log V for V tokens."""
    each = _normalised(l, lambda s: F.transform(s["l"], lambda v, i: F.struct((-F.round(v - s["z"], 9)).alias("s"), i.alias("token"), (v - s["z"]).alias("logprob"))))
    return F.when(F.size(l) > 0, F.transform(F.slice(F.array_sort(each), 1, k), lambda x: F.struct(x["token"].alias("token"), x["logprob"].alias("logprob"))))


def kd_loss(student: Column, teacher_ids: Column, teacher_logprobs: Column, target: Column, temperature: float = 1.0, mix: float = 0.5) -> Column:
    """(ce, kl, mix) of one position. The teacher's K tokens and one bucket for the rest make K + 1
    probabilities at the temperature; the rest's share is at least 1e-6 on both sides. KL is from the teacher
    to the student over the buckets, times the temperature squared; ``mix`` weighs KL against cross-entropy."""
    ce = -token_logprob(student, target)
    cooled = log_softmax(F.transform(student, lambda v: v / temperature))

    def over(t: Column) -> Column:
        """Teacher probabilities of the tokens, cooled among the buckets."""
        held = _with(F.struct(t.alias("p"), F.greatest(F.lit(1e-6), 1 - F.aggregate(t, F.lit(0.0), lambda a, v: a + v)).alias("r")), lambda s: F.concat(s["p"], F.array(s["r"])))
        warm = F.transform(held, lambda v: F.pow(v, F.lit(1.0 / temperature)))
        return _with(F.struct(warm.alias("w"), F.aggregate(warm, F.lit(0.0), lambda a, v: a + v).alias("z")), lambda s: F.transform(s["w"], lambda v: v / s["z"]))

    def own(lps: Column) -> Column:
        p = F.transform(teacher_ids, lambda i: F.exp(F.get(lps, i)))
        return _with(F.struct(p.alias("p"), F.greatest(F.lit(1e-6), 1 - F.aggregate(p, F.lit(0.0), lambda a, v: a + v)).alias("r")), lambda s: F.concat(s["p"], F.array(s["r"])))

    p, q = over(F.transform(teacher_logprobs, lambda v: F.exp(v))), _with(cooled, own)
    kl = temperature**2 * F.aggregate(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * (F.log(x) - F.log(y))).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return _with(F.struct(ce.alias("ce"), kl.alias("kl")), lambda s: F.struct(s["ce"].alias("ce"), s["kl"].alias("kl"), (mix * s["kl"] + (1 - mix) * s["ce"]).alias("mix")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
