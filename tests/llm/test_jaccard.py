import random

import pytest

from lakeval.llm import jaccard
from lakeval.workspace import Workspace

from .conftest import prose


def brute(rows, words, p, q):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] == rows[b][0] and rows[a][0] is not None
            both = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and (same_id or sets[a] and sets[b] and q * both >= p * len(sets[a] | sets[b])):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), None if i is None else least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize(("words", "p"), [(3, 90), (5, 80), (1, 60)])
def test_components_equal_brute_force(spark, docs, corpus, words, p):
    rows = [*corpus, (None, corpus[0][1]), (None, None), (500, "two words"), (501, "Two  WORDS"), (502, "three words here"), (503, "one")]
    rng = random.Random(words)
    chain = prose(rng, 100, 5000).split(" ")
    for k in range(12):  # each like the one before, the ends unlike
        chain[rng.randrange(100)] = f"c{k}"
        rows.append((600 + k, " ".join(chain)))
    got = jaccard.join(docs(rows), Workspace(spark, "t"), words, p, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, words, p, 100)


def test_large_buckets_of_unlinked_documents(spark, docs, monkeypatch):
    """Many documents that share most of their text but aren't linked; common keys are settled in the task."""
    monkeypatch.setattr(jaccard, "COMMON", 3)
    monkeypatch.setattr(jaccard, "FLUSH_KEYS", 100)
    monkeypatch.setattr(jaccard, "PART_BYTES", 500)
    rng = random.Random(9)
    shared = prose(rng, 60, 5000)
    rows = []
    for i in range(14):
        own = prose(rng, 14, 5000)
        rows.append((10 * i, shared + " " + own))
        if i % 3 == 0:
            rows.append((10 * i + 1, shared + " " + own[:-3] + "end"))
    got = jaccard.join(docs(rows), Workspace(spark, "t"), 1, 90, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 1, 90, 100)


def test_empty_table(spark, docs):
    assert jaccard.join(docs([]), Workspace(spark, "t")).count() == 0


def test_linked_sets_share_a_key():
    rng = random.Random(4)
    made = jaccard.Sketches(80, 100)
    for n in (1, 2, 4, 5, 9, 30, 200, 1500):
        for _ in range(20):
            a = set(rng.sample(range(10**9), n))
            b = set(a)
            for _ in range(rng.randrange(n // 4 + 1)):
                b.discard(rng.choice(sorted(b))) if rng.random() < 0.5 else b.add(rng.randrange(10**9))
            import numpy as np

            x, y = (np.sort(np.array(sorted(s), np.uint64)) for s in (a, b))
            if jaccard.linked(x, y, 80, 100):
                assert set(made.keys(x)) & set(made.keys(y))


def test_sketches_bound_the_difference():
    """The Hamming distance of bit sketches, folded to one width, never exceeds the symmetric difference."""
    import numpy as np

    rng = random.Random(6)
    for n in (1, 10, 300, 3000, 12000):
        a = set(rng.sample(range(10**9), n))
        b = {x for x in a if rng.random() < 0.9} | {rng.randrange(10**9) for _ in range(n // 12)}
        x, y = (jaccard.parity_bits(np.array(sorted(s), np.uint64), 80, 100) for s in (a, b))
        while len(x) != len(y):
            x, y = (z[: len(z) // 2] ^ z[len(z) // 2 :] if len(z) > min(len(x), len(y)) else z for z in (x, y))
        assert sum(int(w).bit_count() for w in (x ^ y).view(np.uint64)) <= len(a ^ b)


def test_exact_links():
    assert jaccard.exactly_linked("a b c d", "A  b\nc d", 3, 100, 100) and jaccard.exactly_linked("a b", "A b", 3, 90, 100)
    assert not jaccard.exactly_linked("a b", "a b c", 3, 50, 100) and not jaccard.exactly_linked("", "", 3, 90, 100) and not jaccard.exactly_linked(None, "a", 3, 90, 100)
    rng = random.Random(3)
    for _ in range(200):
        x, y = (" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        w = rng.randrange(1, 4)
        sets = [{tuple(t.split()[i : i + w]) for i in range(len(t.split()) - w + 1)} or {tuple(t.split())} for t in (x, y)]
        assert jaccard.exactly_linked(x, y, w, 60, 100) == (100 * len(sets[0] & sets[1]) >= 60 * len(sets[0] | sets[1])), (x, y, w)


def test_sets_leave_few_segments_empty_to_each_other():
    """Unlike sets of one size have no key in common, as they would by segments that no shingle fell in."""
    import numpy as np

    rng = np.random.default_rng(8)
    made = jaccard.Sketches(80, 100)
    for n in (70, 100, 150, 300, 1000):
        sets = [np.unique(rng.integers(0, 1 << 62, n, np.uint64)) for _ in range(20)]
        keys = [made.keys(s) for s in sets]
        assert len(np.unique(np.concatenate(keys))) > 0.999 * sum(map(len, keys))


def test_linked_sets_share_a_key_that_both_need():
    """Whatever order all keys have, linked sets share one beyond the slack of both."""
    import numpy as np

    rng = np.random.default_rng(9)
    made = jaccard.Sketches(80, 100)
    for n in (5, 9, 30, 47, 200, 1500):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 62, n, np.uint64))
            b = np.unique(np.r_[a[rng.permutation(len(a))[len(a) // 10 :]], rng.integers(0, 1 << 62, n // 10, np.uint64)])
            if not jaccard.linked(a, b, 80, 100):
                continue
            seed, needed = np.uint64(rng.integers(0, 1 << 62)), []
            for s in (a, b):
                keys, slack = made.keys_and_slack(s)
                for low in (0, 1):
                    own = keys[keys & np.uint64(1) == low]
                    needed.append(own[np.argsort((own ^ seed) * np.uint64(0x9E3779B97F4A7C15))][slack[low] :])
            assert set(np.concatenate(needed[:2]).tolist()) & set(np.concatenate(needed[2:]).tolist())


def test_worker_keeps_no_words(spark, docs, ws):
    """What a task hands back is the module's own table of words, not a copy that came with the function."""
    jaccard.describe(docs([(1, "one two three four"), (2, "five six")]).coalesce(1), 3, 90, 100, 1).collect()
    held = spark.sparkContext.parallelize([0], 1).map(lambda _: len(__import__("lakeval.llm.jaccard", fromlist=["x"])._WORDS)).collect()
    jaccard.shingles("one two three four", 3)
    assert jaccard._WORDS
    jaccard._hand_back()
    assert held == [0] and not jaccard._WORDS
