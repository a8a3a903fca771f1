"""Numeric operators whose SQL is no whole check, against plain versions of their definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeval.functions import scorers
from lakeval.operators import baselines, compare


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return row[-1]


def test_longest_common_subsequences(spark):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choice("abcd") for _ in range(rng.randrange(90))), " ".join(rng.choice("abcd") for _ in range(rng.randrange(90)))) for _ in range(60)] + [("", ""), (None, "a"), ("a", None)]
    got = spark.createDataFrame(pairs, "a string, b string").select(scorers.rouge_l(F.col("a"), F.col("b")), scorers.token_f1(F.col("a"), F.col("b"))).collect()
    for (a, b), (rouge, f1) in zip(pairs, got, strict=True):
        x, y = (a or "").split(), (b or "").split()
        both = sum(min(x.count(w), y.count(w)) for w in set(x))
        n = len(x) + len(y)
        assert rouge == pytest.approx(2 * lcs(x, y) / n if x and y and None not in (a, b) else 0.0)
        assert f1 == pytest.approx(2 * both / n if both else 0.0)


def test_moving_average(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.random() * 9) for k in (1, 2, None) for i in range(1 + 40 * (k or 0))]
    got = {r["k"]: r["ema"] for r in compare.ema(spark.createDataFrame(rows, "k long, i long, v double"), "k", "i", "v").collect()}
    for k in (1, 2, None):
        avg = None
        for _, _, v in (r for r in rows if r[0] == k):
            avg = v if avg is None else 0.7 * avg + 0.3 * v
        assert got[k] == pytest.approx(avg)


def test_logistic_regression_agrees_with_direct_minimisation(spark):
    """The share right on held rows equals that of gradient descent on the stated objective."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (40, 3)) for c in ((0, 0, 0), (2, 1, 0), (0, 2, 2))])
    y = np.repeat([0, 1, 2], 40)
    held = np.arange(120) % 4 == 0
    w, b = np.zeros((3, 3)), np.zeros(3)
    one = np.eye(3)[y[~held]]
    for _ in range(4000):
        z = x[~held] @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.01 * (x[~held].T @ (p - one) + w)
        b -= 0.01 * (p - one).sum(axis=0)
    want = ((x[held] @ w + b).argmax(axis=1) == y[held]).mean()
    df = spark.createDataFrame([(v.tolist(), int(c), bool(h)) for v, c, h in zip(x, y, held, strict=True)], "v array<double>, c long, h boolean")
    got = baselines.logreg(df, "v", "c", F.col("h")).head()
    assert (got["n_train"], got["n_test"]) == (90, 30) and got["accuracy"] == pytest.approx(want)
