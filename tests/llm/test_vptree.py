import numpy as np
import pytest

from lakeval.llm import vptree

SCHEMA = "vec_id long, vector array<float>, label int"


def brute(rows, queries, k):
    out = {}
    for q, a in queries:
        best = {}
        for i, b in rows:
            if i != q and len(a) == len(b):
                s = float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
                best[i] = max(best.get(i, -2), s)
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_factor_one_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(vptree, "LEAF_ROWS", 8)
    v = rng.normal(size=(300, 6)).astype(np.float32)
    v[100:140] = v[0]  # ties
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(900, None, 0), (901, [0.0] * 6, 0), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (903, [float("nan")] * 6, 0), (904, [float("inf")] * 6, 0), (905, [], 0), (906, [1.0, 2.0], 0), (None, [1.0] * 6, 0), (907, rows[0][1], 0), (7, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = vptree.search(df, df.filter("vec_id % 50 = 0"), 5, 1.0, shard_rows=90, block=3).collect()
    good = [(i, np.array(x, float)) for i, x, _ in rows] + [(906, np.array([1.0, 2.0])), (907, v[0].astype(float)), (7, v[0].astype(float))]
    want = brute(good, [(i, x) for i, x in good if i % 50 == 0], 5)
    seen = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        seen.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert seen.keys() == {q for q, w in want.items() if w}
    for q, hits in seen.items():
        assert [i for i, _ in hits] == [i for i, _ in want[q]]
        assert [s for _, s in hits] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_larger_factor_trades_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    v = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    tree = vptree.Tree(np.arange(3000), v)
    q = np.arange(0, 3000, 50)
    exact = {(a, b) for a, b, _ in zip(*tree.search(q, v[q], 5), strict=True)}
    found = {(a, b) for a, b, _ in zip(*tree.search(q, v[q], 5, 1.15), strict=True)}
    assert len(exact) == 5 * len(q) and len(exact & found) / len(exact) >= 0.9


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (50, [1.0, 1.0], 1)], SCHEMA)
    assert vptree.search(df, df).count() == 2
    assert vptree.search(df.limit(0), df.limit(0)).count() == 0
