import random

import pytest
from pyspark.sql import functions as F

from lakeval.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(old[j - 1] + (c != d), old[j] + 1, row[-1] + 1))
    return row[-1]


def edited(rng, s, n):
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        s = s[:at] + ("" if kind == 0 else rng.choice("aé日")) + s[at + (kind != 1) :]
    return s


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
def test_automaton_and_keys_against_edit_distance(spark, tau):
    rng = random.Random(tau)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("abc", "abc")]
    for _ in range(300):
        a = "".join(rng.choice("abé日") for _ in range(rng.randrange(8, 30)))
        pairs.append((a, edited(rng, a, rng.randrange(tau + 3))))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", linededup.within_edits(F.col("a"), F.col("b"), tau).alias("near"), F.arrays_overlap(linededup.segment_keys(F.col("a"), tau), linededup.segment_keys(F.col("b"), tau)).alias("meet")).collect()
    for r in got:
        near = distance(r["a"], r["b"]) <= tau
        assert r["near"] == near, (r["a"], r["b"])
        if near and min(len(r["a"]), len(r["b"])) > 2 * tau + 1:
            assert r["meet"], (r["a"], r["b"])


def brute(rows, tau, least):
    found = []
    for i, t in rows:
        if i is not None and t is not None:
            found += [(i, p, f) for p, line in enumerate(t.split("\n")) if len(f := line.strip(" \t\r\x0b\x0c")) >= least]
    forms = sorted({f for *_, f in found})
    up = {f: f for f in forms}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in forms:
        for b in forms:
            if a < b and abs(len(a) - len(b)) <= tau and root(a) != root(b) and distance(a, b) <= tau:
                up[root(a)] = root(b)
    first = {}
    for i, p, f in found:
        first[root(f)] = min(first.get(root(f), (i, p)), (i, p))
    return {(i, p) for i, p, f in found if first[root(f)] < (i, p)}


def test_equals_brute_force(spark, docs, ws):
    rng = random.Random(8)
    lines = ["".join(rng.choice("abc é") for _ in range(rng.randrange(20, 60))) for _ in range(25)]
    rows = []
    for i in range(40):
        rows.append((i, "\n".join(edited(rng, rng.choice(lines), rng.randrange(4)) + rng.choice(["", "  ", "\r"]) for _ in range(rng.randrange(6)))))
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, lines[0]), (3, rows[3][1]), (60, "x" * 30_000), (61, "x" * 30_001), (62, lines[0] + "\n" + lines[0])]
    gone = brute(rows, 2, 30)
    got = linededup.dedup_lines(docs(rows).withColumn("n_lines", F.lit("clash")), ws, 2, 30).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        n = 0 if t is None else t.count("\n") + 1
        want.append((i, kept, n, 0 if t is None else sum((i, p) in gone for p in range(n))))
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got), key=str) == sorted(want, key=str)
    assert linededup.dedup_lines(docs([]), ws).count() == 0


def test_no_python_in_the_plan(spark, docs, ws):
    plan = linededup.dedup_lines(docs([(1, "a" * 40), (2, "a" * 40)]), ws)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_crowded_keys(spark, ws):
    """Many unlinked lines that share a segment, with a linked one to every third."""
    rng = random.Random(3)
    head = "".join(rng.choice("abcdef ") for _ in range(30))
    rows = []
    for i in range(18):
        t = head + "".join(rng.choice("xyz") for _ in range(24))
        rows.append((i, t))
        if i % 3 == 0:
            rows.append((100 + i, t[:-1] + "q"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["pos"]) for r in linededup.repeated_lines(df, ws, 2, 30).collect()} == brute(rows, 2, 30)


def test_short_lines_go_too(spark, docs, ws):
    """Every line that is not blank against brute force: edits in proportion to the shorter line."""

    def allowed(n):
        return 2 if n >= 30 else 1 if n >= 15 else 0

    rng = random.Random(12)
    pool = ["".join(rng.choice("abc é") for _ in range(n)).strip() or "x" for n in [1, 3, 5, 6, 9, 13, 14, 15, 16, 22, 28, 29, 30, 31, 45] for _ in range(3)]
    rows = [(i, "\n".join(edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 1, 2, 3])) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    rows += [(100, "All rights reserved.\n\nLes."), (101, "Les.\n\nAll rights reserved.\nAll right reserved."), (102, "Les!"), (None, "Les."), (103, "y" * 29), (104, "y" * 30), (105, "y" * 32)]
    found = [(i, p, f) for i, t in rows if i is not None for p, x in enumerate(t.split("\n")) if (f := x.strip(" \t\r\x0b\x0c"))]
    group = {f: f for *_, f in found}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sorted(group):
        for b in sorted(group):
            if a < b and distance(a, b) <= allowed(min(len(a), len(b))):
                group[root(a)] = root(b)
    first = {}
    for i, p, f in found:
        first[root(f)] = min(first.get(root(f), (i, p)), (i, p))
    gone = {(i, p) for i, p, f in found if first[root(f)] < (i, p)}
    assert {(101, 0), (101, 2), (101, 3), (104, 0), (105, 0)} <= gone and not {(100, 1), (101, 1), (102, 0)} & gone
    got = linededup.repeated_lines(docs(rows), ws, 2, 30, 1).collect()
    assert {(r["doc_id"], r["pos"]) for r in got} == gone
    from lakeval.llm.queries import op10_line_dedup as q

    assert (q.TAU, q.MIN_CHARS, q.LEAST) == (2, 30, 1)


def test_columns_that_clash(spark, ws):
    """Input columns named like the operator's own; they stay."""
    rows = [(1, "x" * 40, 5, "a", 1, 2), (2, "x" * 40 + "\ny", 6, "b", 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone long, form string, node long, pos long")
    got = linededup.dedup_lines(df, ws, 2, 30, 1).orderBy("doc_id").collect()
    assert [(r["text"], r["n_removed"], r["gone"], r["form"], r["node"], r["pos"]) for r in got] == [("x" * 40, 0, 5, "a", 1, 2), ("y", 1, 6, "b", 3, 4)]


def test_keys_are_code_that_the_jvm_compiles(spark):
    """HotSpot leaves methods of over 8,000 bytes to its interpreter."""
    df = spark.createDataFrame([(1, "x" * 40, 40)], "node long, form string, n int")
    plan = linededup.line_keys(df, 2, 30, 1)._jdf.queryExecution().executedPlan()
    codes = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan)
    sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
    assert sizes and max(sizes) < 8000


def test_tags_of_keys(spark):
    """Own keys and probes of the spans of lengths, against those of one number of edits."""
    rng = random.Random(21)
    rows = [(i, "".join(rng.choice("abé日😀") for _ in range(n))) for i, n in enumerate([0, 1, 14, 15, 16, 29, 30, 31, 32, 60])]
    df = spark.createDataFrame(rows, "node long, form string").withColumn("n", F.length("form"))
    want = set()
    for e, low, high in ((1, 15, 31), (2, 30, 1 << 30)):
        for r in df.filter((F.col("n") >= low) & (F.col("n") < high)).select("node", linededup.segment_keys(F.col("form"), e).alias("keys")).collect():
            own = [p[1] == 0 and p[3] == 0 for p in linededup._places(e)]
            assert sum(own) == e + 1
            want |= {(k, r["node"] if o else -r["node"] - 1) for k, o in zip(r["keys"], own, strict=True)}
    assert {(r["key"], r["tag"]) for r in linededup.line_keys(df, 2, 30, 1).collect()} == want


def test_counts_and_pieces(spark):
    """Counts of letters by class, and what a pair within some edits always passes and unlike ones mostly don't."""
    rng = random.Random(22)
    pairs = []
    for k in range(300):
        a = "".join(rng.choice("abcXYZ019 éİ日") for _ in range(rng.randrange(0, 60)))
        pairs.append((a, edited(rng, a, k % 3), k % 3))
    df = spark.createDataFrame(pairs, "a string, b string, k int")
    for r in df.select("a", F.struct(*linededup._counts(F.col("a"))).alias("c"), F.lower("a").alias("low")).collect():
        assert list(r["c"]) == [sum(r["low"].count(x) for x in c) for c in linededup._CLASSES], r["a"]
    assert df.filter((F.col("k") <= 2) & ~linededup.pieces_meet(F.col("a"), F.col("b"), 2)).count() == 0
    line = "the quick brown fox jumps over the lazy dog"
    unlike = spark.createDataFrame([(line, line[:20] + line[:19:-1])], "a string, b string")
    assert unlike.filter(linededup.pieces_meet(F.col("a"), F.col("b"), 2)).count() == 0
    assert unlike.filter(linededup.linked(F.col("a"), F.col("b"), 2, 30, 1)).count() == 0


def test_forms_of_lines(spark):
    """Ends without ASCII white space, whichever stands there; other white space stays."""
    rows = [("a",), ("",), (" ",), (" \t\r\x0b\x0c",), (" a b ",), ("a\r",), ("\x0ba",), ("\u00a0a\u3000",), ("日 \t",), ("\x0c日",)]
    for r in spark.createDataFrame(rows, "t string").select("t", linededup.line_form(F.col("t")).alias("f")).collect():
        assert r["f"] == r["t"].strip(" \t\r\x0b\x0c")
