"""Operators that SQL does not cover, and invariants, on hand-written rows."""

import random

import pytest
from pyspark.sql import functions as F

from lakeval.functions import jsontools, planning, scorers
from lakeval.functions.text import normalized_any, strip
from lakeval.operators import baselines, chat, rows, splits
from lakeval.operators.components import connected_components
from lakeval.sources import files
from lakeval.streaming.rowjob import IdentityChanged, RowJob
from lakeval.workspace import Workspace


@pytest.fixture
def ws(spark):
    made = Workspace(spark, "test")
    yield made
    made.close()


def test_components_of_random_graphs(spark, ws):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, None), (7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    assert got == {n: root(n) for n in got}
    assert set(got) == {n for a, b in edges if b is not None and a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), ws).count() == 0


def test_deal_keeps_components_and_shares(spark):
    members = [(c, c % 7 + 1) for c in range(60)]
    df = spark.createDataFrame([(c,) for c, n in members for _ in range(n)], "component long")
    got = splits.deal(df, "seed", 0.1, 0.2).collect()
    total = sum(n for _, n in members)
    by = {s: sum(r["size"] for r in got if r["split"] == s) for s in ("train", "val", "test")}
    assert sum(by.values()) == total and len(got) == 60
    assert round(total * 0.1) <= by["test"] < round(total * 0.1) + 7 and round(total * 0.2) <= by["val"] < round(total * 0.2) + 7
    assert sorted(map(tuple, got)) == sorted(map(tuple, splits.deal(df.repartition(5), "seed", 0.1, 0.2).collect()))


def test_row_ids_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("f", i, "a", "b" if i % 2 else "c") for i in range(6)], "file string, row long, given string, wanted string")
    one, other = (sorted(r["id"] for r in rows.with_row_ids(d, "given", "wanted", ["file", "row"]).collect()) for d in (df, df.repartition(4)))
    assert one == other and len(set(one)) == 6 and sum(x.endswith("-2") for x in one) == 2


def test_normal_form_of_any_text(spark):
    df = spark.createDataFrame([("ﬁne  STRASSE\n",), ("Straße",), (None,)], "t string")
    assert [r[0] for r in df.select(normalized_any("t")).collect()] == ["fine strasse", "strasse", None]
    assert df.select(strip(F.lit("\t a b \n"))).head()[0] == "a b"


def test_scorers(spark):
    s = scorers
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(s.pointwise_score(F.lit("Score: 2 then Score: 4"))) == 4 and one(s.pointwise_score(F.lit("Score: 9"))) is None
    assert one(s.pairwise_pick(F.lit("Better: A. Better: tie"))) == "tie"
    assert [one(s.pointwise_score(F.lit(x))) for x in ("Score 4", "score = 4", "Score: **3**", "Score: 45", "4")] == [4, 4, 3, None, None]
    assert [one(s.pairwise_pick(F.lit(x))) for x in ("Better: answer A", "better - **b**", "BETTER TIE", "Better: C", "a")] == ["A", "B", "tie", None, None]
    assert [one(s.unit_score(F.lit(x))) for x in ("10 or 0.5", "about 0.5.", "1.", ".5", "Score .75 ok", "1.0", "2.5", "")] == [0.5, None, None, 0.5, 0.75, 1.0, None, None]
    assert [one(s.rationale(F.lit(x))) for x in ("Rationale: good\nand short. \nScore: 5", "just words ", "x" * 700)] == ["good\nand short.", "just words", "x" * 600]
    assert one(s.rouge_l(F.lit("a b c d"), F.lit("a x c d"))) == pytest.approx(0.75)
    assert one(s.rouge_l(F.lit(""), F.lit("a"))) == 0
    assert one(s.token_f1(F.lit("a a b"), F.lit("a b b"))) == pytest.approx(4 / 6)
    assert one(s.exact_match(F.lit(" x\n"), F.array(F.lit("y"), F.lit("x")))) == 1 and one(s.exact_match(F.lit(None).cast("string"), F.array(F.lit("x")))) is None
    field = lambda t, e: one(s.json_field(F.lit(t), F.lit(e)))
    assert field('so {"a": [{"b": 5}]} it is', "a.0.b=5") == 1 and field('{"a": "5"}', "a=5") == 0 and field('{"a": 1.0}', "a=1") == 1
    assert field('{"a": 1, "b": "x"}', '{"a": 1, "b": "x"}') == 1 and field('{"a": 1}', '{"a": 1, "b": "x"}') == 0 and field("nothing", "a=1") == 0 and field('{"a": "x y"}', "a=x y") == 1
    assert one(s.json_field(F.lit(None).cast("string"), F.lit("a=1"))) is None
    assert one(s.parse_json_strict(F.lit("```json\n[1]\n```")).isNotNull()) and not one(s.parse_json_strict(F.lit("see [1]")).isNotNull())


def test_durations(spark):
    df = spark.createDataFrame([("1d12h",), ("90 m",), ("",), ("soon",), (None,), ("5s",), ("1.5h",), ("2h 30m",), ("1w",), ("0s",), ("5x",)], "t string")
    assert [r[0] for r in df.select(planning.parse_duration(F.col("t"))).collect()] == [129600, 5400, None, None, None, 5, 5400, 9000, 604800, None, None]
    seconds = [5, 75, 89.5, 90, 5000, 5399, 7260, 100000, 172799, 172800, 3780, 0.5]
    assert [r[0] for r in spark.createDataFrame([(float(x),) for x in seconds], "s double").select(planning.format_duration(F.col("s"))).collect()] == ["5 s", "75 s", "90 s", "2 min", "83 min", "90 min", "2.0 h", "27.8 h", "48.0 h", "2.0 days", "63 min", "0 s"]
    stamps = [("2026-10-14T09:00",), ("2026-10-14 09:00",), ("2026-10-14T09:00:30",), ("2026-10-15",), ("2026-10-13",), ("2h",), ("2026-13-01",)]
    now = F.lit("2026-10-14 08:00:00").cast("timestamp")
    assert [r[0] for r in spark.createDataFrame(stamps, "t string").select(planning.parse_deadline(F.col("t"), now)).collect()] == [3600, 3600, 3630, 57600, None, 7200, None]


def test_json_tools(spark):
    assert jsontools.equal({"a": 1}, {"a": 1.0}) and not jsontools.equal(True, 1) and jsontools.equal(" é", "é")
    assert jsontools.equal([1, 2], [2, 1], {"x-unordered": True}) and not jsontools.equal([1, 2], [2, 1])
    schema = {"type": "object", "properties": {"k": {"enum": ["a", "b"]}, "n": {"type": "integer"}}, "required": ["k"], "additionalProperties": False}
    assert jsontools.violation({"k": "a", "n": 2.0}, schema) is None
    assert jsontools.violation({"n": 1}, schema) == "$.k: missing" and "not expected" in jsontools.violation({"k": "a", "z": 1}, schema)
    df = spark.createDataFrame([('{"k":"a","n":1}', '```json\n{"n": 1, "k": "a"}\n```'), ('{"k":"a","n":1}', '{"k": "b"}'), ('{"k":"a"}', '{"k": "c"}'), ('{"k":"a"}', None), ('{"k":"a"}', "no")], "g string, o string")
    got = [tuple(r[0]) for r in df.select(jsontools.json_scorer(schema)("g", "o")).collect()]
    assert got == [(True, True, True, {"k": True, "n": True}, []), (True, True, False, {"k": False, "n": False}, []), (True, False, False, {"k": False, "n": False}, []), (False, False, False, {}, []), (False, False, False, {}, [])]
    assert not jsontools.equal([True], [1]) and jsontools.equal({"a": [1, 1, 2]}, {"a": [2, 1, 1]}, {"properties": {"a": {"x-unordered": True}}}) and not jsontools.equal([1, 1, 2], [1, 2, 2], {"x-unordered": True})
    derived = jsontools.derive_schema(spark.createDataFrame([('{"a": 1}',), ('{"a": 1.5, "b": [true]}',), ("x",)], "t string").repartition(3), "t")
    assert derived == {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "array", "items": {"type": "boolean"}}}, "required": ["a"], "additionalProperties": False}


def test_logits(spark):
    import math

    from lakeval.functions import logits

    x = spark.createDataFrame([([0.0, 1.0, 2.0, 2.0],), ([],), (None,)], "l array<double>")
    z = math.log(1 + math.e + 2 * math.e**2)
    got = x.select(logits.log_softmax(F.col("l")), logits.token_logprob(F.col("l"), F.lit(1)), logits.top_tokens(F.col("l"), 3)).collect()
    assert got[0][0] == pytest.approx([-z, 1 - z, 2 - z, 2 - z]) and got[0][1] == pytest.approx(1 - z) and [t["token"] for t in got[0][2]] == [2, 3, 1]
    assert got[1] == (None, None, None) and got[2] == (None, None, None)
    one = x.limit(1).select(logits.kd_loss(F.col("l"), F.array(F.lit(2), F.lit(0)), F.array(F.lit(math.log(0.7)), F.lit(math.log(0.2))), F.lit(3), 2.0, 0.25)).head()[0]
    t = [math.sqrt(p) for p in (0.7, 0.2, 0.1)]
    t = [p / sum(t) for p in t]
    e = [math.exp(v / 2) for v in (0, 1, 2, 2)]
    s = [e[2] / sum(e), e[0] / sum(e)]
    s.append(1 - sum(s))
    kl = 4 * sum(p * math.log(p / q) for p, q in zip(t, s, strict=True))
    assert (one["ce"], one["kl"], one["mix"]) == pytest.approx((z - 2, kl, 0.25 * kl + 0.75 * (z - 2)))
    assert x.limit(1).select(logits.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))).head()[0] == pytest.approx(0.5**0.5)


def test_scripts(spark, tmp_path):
    (tmp_path / "m.py").write_text("def score(row):\n    return None if row['expected'] is None else len(row['text']) / 2\n")
    df = spark.createDataFrame([("a", "x", "e"), ("b", "xxxx", "e"), ("c", None, "e"), ("d", "x", None)], "i string, t string, e string")
    assert [r[0] for r in df.select(scorers.metric(f"script:{tmp_path}/m.py")("i", "t", "e")).collect()] == [0.5, 1.0, None, None]
    (tmp_path / "p.py").write_text("def score(row):\n    return 10 * len(row['pred'])\n")
    f = scorers.project_script(str(tmp_path / "p.py"))
    assert [r[0] for r in df.filter("i = 'a'").select(f("i", "t", "e", "t", "t")).collect()] == [10.0]
    with pytest.raises(Exception, match="row c"):
        df.select(f("i", "t", "e", "t", "t")).collect()
    with pytest.raises(ValueError):
        scorers.metric("none such")


def test_protocols_are_apart(spark):
    from lakeval.operators import compare

    runs = spark.createDataFrame([("x|y", "z"), ("x", "y|z"), (None, "z"), ("-", "z")], "a string, b string")
    assert compare.protocol_groups(runs, ["a", "b"]).select("protocol").distinct().count() == 4


def test_csv_with_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"one, ""two""\nthree",x\n\nbad\n four ,y\n', encoding="utf-8")
    (tmp_path / "b.csv").write_bytes(b"text,label\n\xff\xfe,x\n")
    (tmp_path / "c.csv").write_text("a,a\n1,2\n")
    (tmp_path / "d.csv").write_text("\n")
    good, bad = files.read_table(spark, str(tmp_path))
    assert sorted((r["row"], r["values"]["text"]) for r in good.collect()) == [(1, 'one, "two"\nthree'), (3, " four ")]
    assert sorted((r["file"][-5:], r["row"]) for r in bad.collect()) == [("a.csv", 2), ("b.csv", 0), ("c.csv", 0), ("d.csv", 0)]


def test_manifest(spark, tmp_path):
    (tmp_path / "x").write_text("1")
    (tmp_path / "y").write_text("2")
    before = files.manifest(spark, str(tmp_path)).collect()
    old = spark.createDataFrame(before, "path string, bytes long, sha256 string")
    (tmp_path / "x").write_text("3")
    (tmp_path / "y").unlink()
    (tmp_path / "z").write_text("4")
    found = {r["path"][-1]: r["problem"] for r in files.manifest_problems(old, files.manifest(spark, str(tmp_path))).collect()}
    assert found == {"x": "changed", "y": "missing", "z": "extra"}


def test_row_job_resumes_and_guards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "custom_id long, prompt string")
    df.filter("custom_id < 6").write.parquet(f"{tmp_path}/in")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(answer=pdf.prompt + "!")[["custom_id", "answer"]]

    def job(**identity):
        return RowJob(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", identity, df.schema)

    a = job(model="m")
    a.run(run, "custom_id long, answer string")
    assert a.remaining(df).count() == 4
    df.filter("custom_id >= 4").write.mode("append").parquet(f"{tmp_path}/in")
    b = job(model="m")
    b.run(run, "custom_id long, answer string")
    assert sorted((r["custom_id"], r["answer"]) for r in b.results().collect()) == [(i, f"p{i}!") for i in range(10)]
    with pytest.raises(IdentityChanged):
        job(model="other").run(run, "custom_id long, answer string")


def test_chat_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", None)], "c long, n int, role string, text string")
    got = {r["c"]: r for r in chat.batch_rows(chat.messages(turns, "c", "n").withColumn("ok", chat.valid(F.col("messages"))), "c").collect()}
    assert got[1]["target"] == "a" and len(got[1]["messages"]) == 1 and got[1]["ok"] and got[1]["custom_id"] == "row-000001"
    assert got[2]["target"] is None and not got[2]["ok"]


def test_tfidf_without_a_shared_word(spark):
    train = spark.createDataFrame([(3, "red apple"), (4, "green pear")], "id long, text string")
    q = spark.createDataFrame([(1, "a pear"), (2, "nothing"), (3, None)], "q long, text string")
    got = {r["q"]: (r["id"], round(r["similarity"], 3)) for r in baselines.tfidf_nearest(train, q, "q").collect()}
    assert got[1][0] == 4 and got[1][1] > 0 and got[2] == (3, 0.0) and got[3] == (3, 0.0)


def test_tfidf_of_bounded_workers(spark):
    """Whatever workers hold, the nearest are those of brute force; repeated ids are one row, ties go to the least."""
    import math
    import random
    from collections import Counter

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(k % 70, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(1, 30)))) for k in range(80)]
    rows += [(100 + k, rows[20][1]) for k in range(3)] + [(None, "only here"), (200, None)]
    queries = [(k, " ".join(rng.choices(vocabulary, k=6))) for k in range(12)] + [(50, rows[20][1])]
    bags: dict = {}
    for i, t in rows:
        if i is not None:
            bags.setdefault(i, Counter()).update((t or "").split())
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + d)) + 1 for w, d in df.items()}
    length = {i: math.sqrt(sum((c * idf[w]) ** 2 for w, c in b.items())) for i, b in bags.items()}
    want = {}
    for k, t in queries:
        x = {w: c * idf[w] for w, c in Counter(t.split()).items() if w in idf}
        ql = math.sqrt(sum(v * v for v in x.values()))
        want[k] = min((-round(sum(v * b[w] * idf[w] for w, v in x.items()) / (ql * length[i]), 9), i) for i, b in bags.items() if length[i])
    train, asked = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(queries, "q long, text string")
    for head, most in ((50_000, 2_000), (5, 4)):
        got = {r["q"]: (-r["similarity"], r["id"]) for r in baselines.tfidf_nearest(train, asked, "q", head=head, most=most).collect()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
        assert all(abs(got[k][0] - want[k][0]) < 2e-9 for k in want)


def test_entry_without_the_optional_parts():
    import __spark_entry__ as e

    assert e._optional("lakeval.no_such_module") is None
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_with_the_subpackage_deleted(tmp_path):
    """A copy without the subpackage, its tests and with or without the pipeline still has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lakeval", tmp_path / "lakeval", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'row_ids' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_intake_of_odd_records(spark):
    from lakeval.operators import intake

    schema = "file string, row long, values map<string,string>"
    rows = [("a", 1, {"x": " in ", "y": " out "}), ("a", 2, {"x": None, "y": "o"}), ("a", 3, {"x": "i"}), ("a", 4, None), ("b", 1, {"x": "i"})]
    good, bad = intake.map_rows(spark.createDataFrame(rows, schema), "x", "y")
    assert [(r["row"], r["input"], r["output"], r["group"]) for r in good.collect()] == [(1, " in ", "out", None)]
    assert sorted((r["file"], r["where"], r["problem"]) for r in bad.collect()) == [("a", "row 2", "empty input"), ("a", "row 3", "empty output"), ("a", "row 4", "empty input"), ("b", "header", "no column y")]
    good, bad = intake.map_rows(spark.createDataFrame([], schema), "x", "y")
    assert good.count() == 0 and bad.count() == 0
    assert intake.declared_labels("a, b\nc") == ["a", "b", "c"]
    for text in ("a", "a,b,a", ""):
        with pytest.raises(ValueError):
            intake.declared_labels(text)


def test_prompt_files(spark):
    from lakeval.operators import intake

    lines = ['{"prompt": "p", "system": "s"}', "", None, '{"custom_id": "a", "messages": [{"role": "user", "content": "u"}], "system": "t"}', '{"custom_id": "a", "prompt": "p", "answer": "x"}', '{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "x", "weight": true}]}']
    df = spark.createDataFrame(list(enumerate(lines, 1)), "n long, value string")
    rows, issues = intake.prompt_rows(df, "value", "n")
    got = {r["n"]: r for r in rows.collect()}
    assert set(got) == {1, 4} and got[1]["custom_id"] == "row-000001" and [m["role"] for m in got[4]["messages"]] == ["system", "user"]
    assert sorted((r["n"], r["problem"]) for r in issues.collect()) == [(5, "duplicate custom_id"), (6, "weight must be 0 or 1")]
    rows, issues = intake.prompt_rows(df.filter("n = 5 or n = 1"), "value", "n", mode="score")
    assert [r["n"] for r in rows.collect()] == [5] and [r["problem"] for r in issues.collect()] == ["no target"]


def test_splits_that_were_supplied(spark):
    from lakeval.operators import intake

    rows = [(i, None if i < 6 else "val" if i < 8 else "test") for i in range(10)]
    comps = spark.createDataFrame([(i, i // 2) for i in range(10)], "id long, component long")
    both = intake.resolved_split(spark.createDataFrame(rows, "id long, given string"), comps, "s", 0.2, 0.2)
    assert {r["split"] for r in both.collect()} == {"train", "val", "test"} and {r["mode"] for r in both.collect()} == {"supplied"}
    one = intake.resolved_split(spark.createDataFrame([(i, "val" if g == "val" else None) for i, g in rows], "id long, given string"), comps, "s", 0.2, 0.2).collect()
    assert len(one) == 10 and {r["mode"] for r in one} == {"mixed"} and sum(r["split"] == "test" for r in one) == 2
    none = intake.resolved_split(spark.createDataFrame([(i, None) for i in range(10)], "id long, given string"), comps, "s", 0.2, 0.2)
    assert {r["mode"] for r in none.collect()} == {"generated"}


def test_row_ids_of_hot_texts(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else "other") for i in range(500)], "n long, given string").withColumn("wanted", F.lit("w")).repartition(5)
    got = rows.with_row_ids(df, "given", "wanted", ["n"]).orderBy("n").collect()
    seen = {}
    for r in got:
        base = r["id"] if r["id"].count("-") == 1 else r["id"].rpartition("-")[0]
        n = seen.get(base, 0)
        assert r["id"] == (base if not n else f"{base}-{n}")
        seen[base] = n + 1


def test_files_written_and_bundled(spark, tmp_path):
    import os

    from lakeval.operators import records

    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_bytes(b"one")
    (src / "sub" / "b.bin").write_bytes(bytes(range(256)))
    made = files.make_bundle(spark, str(src), str(tmp_path / "bundle"))
    assert sorted((r["path"], r["bytes"]) for r in made.collect()) == [("a.txt", 3), ("sub/b.bin", 256)]
    assert files.install_bundle(spark, str(tmp_path / "bundle"), str(tmp_path / "out")) == 2
    assert (tmp_path / "out" / "sub" / "b.bin").read_bytes() == bytes(range(256))
    files.write_lines(spark.createDataFrame([(2, "x"), (None, "y")], "b long, a string").coalesce(1), str(tmp_path / "lines"))
    assert sorted(x for p in (tmp_path / "lines").glob("part-*.json") for x in p.read_text().splitlines()) == ['{"a":"x","b":2}', '{"a":"y"}']
    with pytest.raises(Exception, match="already exists"):
        files.write_lines(spark.createDataFrame([(1,)], "b long"), str(tmp_path / "lines"))
    for n, name in enumerate(("train.jsonl", "x.distill.jsonl", "other.jsonl")):
        (src / name).write_text("{}")
        os.utime(src / name, (1000 + n, 1000 + n))
    assert files.newest_training_file(spark, str(src)).endswith("x.distill.jsonl")
    payloads = spark.createDataFrame([("p", b"abc")], "name string, content binary")
    assert [tuple(r)[::2] for r in records.put_payloads(payloads, str(tmp_path / "payloads")).collect()] == [("p", 3)]
    with pytest.raises(Exception, match="already exists"):
        records.put_payloads(payloads, str(tmp_path / "payloads"))
    events = spark.createDataFrame([("start", "2026-01-01", "j", "{}")], "event string, at string, job string, data string")
    records.write_events(events, str(tmp_path / "events"))
    with pytest.raises(Exception, match="no such event"):
        records.write_events(events.withColumn("event", F.lit("begin")), str(tmp_path / "events"))
    assert spark.read.json(str(tmp_path / "events")).count() == 1
    assert records.gate(spark.createDataFrame([("few rows",)], "problem string"), False) == ["few rows", "the deadline cannot be met"] and records.gate(spark.createDataFrame([], "problem string"), None) == []
