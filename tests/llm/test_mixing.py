from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeval.llm import mixing
from lakeval.llm.queries.op3_mixing import weight_of


def test_targets_share_the_excess():
    got = mixing.targets([10, 100, 90], [5, 2, 1], 3.0)
    assert got == pytest.approx([30, 170 * 2 / 3, 170 / 3])
    assert mixing.targets([0, 0], [5, 2], 3.0) == [0, 0]
    assert mixing.targets([], [], 3.0) == []


def test_pivot_keeps_the_sum_and_the_probabilities():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 50, 40).astype(float)
    share = np.full(40, 0.3)
    total = np.zeros(40)
    for k in range(3000):
        x, at = mixing.pivot(size, share, rng.random(40), last=False)
        assert (size * x).sum() == pytest.approx((size * share).sum())
        assert sum(v not in (0, 1) for v in x) <= 1
        x, at = mixing.pivot(size, share, rng.random(40), last=True)
        assert set(x) <= {0.0, 1.0} and at == -1
        total += x
    assert np.abs(total / 3000 - 0.3).max() < 0.06


def test_large_documents_settle_first():
    """One document of half the words: the words taken still come to the target but for a small document."""
    rng = np.random.default_rng(2)
    size = np.concatenate([[5000.0], rng.integers(1, 40, 250)])
    share = np.full(len(size), 0.37)
    total = np.zeros(len(size))
    for k in range(2000):
        x, _ = mixing.pivot(size, share, rng.random(len(size)), last=True)
        assert set(x) <= {0.0, 1.0}
        total += x
    assert abs(total[0] / 2000 - 0.37) < 0.05 and np.abs(total / 2000 - 0.37).max() < 0.08
    size = np.concatenate([[500.0], rng.integers(1, 40, 250)])
    for k in range(200):
        x, _ = mixing.pivot(size, share, rng.random(len(size)), last=True)
        assert abs((size * x).sum() - (size * share).sum()) <= 10


def test_words_are_runs_between_ascii_white_space(spark, docs):
    texts = [None, "", " \t\n\r\x0b\x0c", "a", " a  b\nc ", "a\u00a0b c", "x " * 50_000]
    got = mixing.count_words(docs(enumerate(texts)).withColumn("size", F.lit("clash"))).orderBy("doc_id").collect()
    assert [r["size"] for r in got] == [0 if t is None else len(t.encode().split()) for t in texts]


def test_mix_meets_targets_whatever_the_partitions(spark, docs, corpus, ws):
    df = mixing.count_words(docs(corpus))
    runs = []
    for n in (1, 5):
        out = mixing.mix(df.repartition(n), ws, weight_of, block_rows=7).collect()
        runs.append(sorted((r["doc_id"], r["source"] or "", r["size"], r["copies"]) for r in out))
    assert runs[0] == runs[1] and len(runs[0]) == len(corpus)
    by = defaultdict(list)
    for r in out:
        assert r["copies"] <= 3 and (r["size"] or not r["copies"])
        by[r["source"]].append(r)
    for rows in by.values():
        largest = max(r["size"] for r in rows)
        miss = abs(sum(r["copies"] * r["size"] for r in rows) - rows[0]["target"])
        assert miss <= largest and (miss <= 40 or 2 * largest > rows[0]["source_size"])
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)


def test_mixed_rows_repeat_and_drop(spark, docs, corpus, ws):
    df = docs([*corpus, (None, "one two"), (None, "one two")])
    want = Counter()
    sized = mixing.count_words(df)
    for r in mixing.mix(sized, ws, weight_of).collect():
        want[r["doc_id"]] += r["copies"]
    out = mixing.mixed_rows(df, ws, weight_of)
    assert out.columns == df.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == +want
    assert mixing.mixed_rows(docs([]), ws, weight_of).count() == 0
