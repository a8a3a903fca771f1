import random

import pytest

from lakeval.llm import substrings


def brute(rows, width):
    first = {}
    for i, t in rows:
        for k in range(len(t) - width + 1):
            w = t[k : k + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if first[t[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        out.append((i, len(t), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("width", [17, 50])
@pytest.mark.parametrize("hot", [20_000, 1])
def test_equals_brute_force(spark, docs, corpus, ws, monkeypatch, width, hot):
    monkeypatch.setattr(substrings, "HOT_NAMES", hot)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 3000)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 9000)
    rng = random.Random(width)
    rows = [(i, t) for i, t in corpus if t is None or len(t) < 5000]
    shared = "".join(rng.choice("abc ") for _ in range(300))
    for k in range(40):
        at = rng.randrange(200)
        rows.append((300 + k, "".join(rng.choice("xyz") for _ in range(rng.randrange(40))) + shared[at : at + rng.randrange(20, 100)] + "q" * rng.randrange(80)))
    got = substrings.remove_repeats(docs(rows), ws, width).collect()
    assert sorted((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in got) == brute([(i, (t or "").encode()) for i, t in rows], width)
    assert all(r["n_bytes"] - len(r["kept"]) == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)


def test_null_ids_stay_whole(spark, docs, ws):
    t = "z" * 30 + "long enough to be removed if it were a later document"
    got = substrings.remove_repeats(docs([(None, t), (5, t), (7, t)]), ws).collect()
    assert sorted((str(r["doc_id"]), len(r["kept"])) for r in got) == [("5", len(t)), ("7", 0), ("None", len(t))]
    assert substrings.remove_repeats(docs([]), ws).count() == 0


def test_buckets_are_whole_strings():
    """Equal strings and no others share a bucket, whatever the window."""
    import numpy as np

    from lakeval.llm import substrings

    rng = np.random.default_rng(5)
    for window in (17, 31, 32, 50, 64):
        texts = rng.integers(97, 99, (40, window + 9), np.uint8)
        texts[20:30] = texts[3]
        texts[30:, 4:] = texts[5, 2:-2]
        got = substrings.refined(texts, window)
        assert got.shape == (40, 10)
        seen = {}
        for row in range(40):
            for at in range(10):
                seen.setdefault(int(got[row, at]), set()).add(texts[row, at : at + window].tobytes())
        assert all(len(v) == 1 for v in seen.values())
        assert len(seen) == len({x for v in seen.values() for x in v})


def test_short_strings_in_common_bring_few_runs_together():
    """Texts made of the same phrases in other orders hardly share a leader, as no window of theirs is equal."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    phrases = ["".join(rng.choice("abcdefghij ") for _ in range(20)) for _ in range(300)]
    texts = ["".join(rng.choice(phrases) for _ in range(2000)).encode() for _ in range(2)]
    a, b = (substrings.Batch(pa.table({"doc_id": [k], "data": [t]}), 50).leader for k, t in enumerate(texts))
    assert np.isin(a, b).mean() < 0.2


@pytest.mark.parametrize("width", [24, 47, 48, 64, 200])
def test_leaders_of_other_widths_equal_brute_force(spark, docs, ws, monkeypatch, width):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 3000)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 9000)
    rng = random.Random(width)
    shared = "".join(rng.choice("abc ") for _ in range(400)) + "xy" * 150
    rows = [(k, "".join(rng.choice("xyz") for _ in range(rng.randrange(40))) + shared[(at := rng.randrange(500)) : at + rng.randrange(20, 300)] + "q" * rng.randrange(80)) for k in range(40)]
    got = substrings.remove_repeats(docs(rows), ws, width).collect()
    assert sorted((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in got) == brute([(i, t.encode()) for i, t in rows], width)


def test_blocks_are_seamless_and_small(monkeypatch):
    """Runs don't depend on where blocks end, and naming a batch takes little more than the batch."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    texts = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.choice([0, 3, 49, 50, 51, 400]))) for _ in range(300)] + [b"q" * 500, b"xy" * 300]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "data": pa.array(texts, pa.binary())})
    want = substrings.Batch(table, 50)
    for block in (64, 701, 5000):
        monkeypatch.setattr(substrings, "BLOCK", block)
        got = substrings.Batch(table, 50)
        assert all(np.array_equal(getattr(want, k), getattr(got, k)) for k in ("lo", "n", "leader", "doc", "name"))
    held = sum(int(n) - 49 for n in want.lengths if n >= 50)
    assert want.n.sum() == held and want.n.max() <= substrings.most_run(50)

    monkeypatch.undo()
    text = random.Random(5).randbytes(3 << 20)
    long = pa.table({"doc_id": pa.array([1], pa.int64()), "data": pa.array([text], pa.binary())})
    tracemalloc.start()
    substrings.Batch(long, 50, named=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)
