import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lakeval.llm import bpe

from .test_jaccard import brute as components
from .test_linededup import brute as repeated


def test_stages_one_by_one(spark, docs, corpus, ws):
    rows = [r for r in corpus if r[0] != 1000] + [(2000, "!!! 123"), (2001, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")]
    df = docs(rows)
    one = ws.save(corpus_pipeline.language(spark, df, ""), "one")
    kept = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert one.columns == df.columns
    assert sorted(kept) == sorted((i, t) for i, t in rows if t and any(c.isalpha() for c in t))
    two = ws.save(corpus_pipeline.lines(spark, one, ""), "two")
    gone = repeated(kept, corpus_pipeline.TAU, corpus_pipeline.MIN_CHARS)
    want = sorted((i, "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)) for i, t in kept)
    left = [(r["doc_id"], r["text"]) for r in two.collect()]
    assert sorted(left) == want and two.columns == df.columns
    three = ws.save(corpus_pipeline.near_copies(spark, two, ""), "three")
    stay = {i for i, _, c in components(left, 5, 80, 100) if i == c}
    ids = [r["doc_id"] for r in three.collect()]
    assert sorted(ids) == sorted(stay) and three.columns == df.columns
    four = ws.save(corpus_pipeline.mix(spark, three, ""), "four")
    assert four.columns == df.columns and {r["doc_id"] for r in four.collect()} <= stay
    five = corpus_pipeline.tokens(spark, four, "").collect()
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = dict(left)
    assert len(five) == four.count()
    for r in five:
        assert r["restored"] and np.frombuffer(r["token_ids"], "<u4").tolist() == encode.encode_ordinary(text[r["doc_id"]])


def test_run_on_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "shingle_join", "mixing", "byte_bpe"]


def test_unlike_texts_of_one_id_stay(spark, docs):
    """Rows of one doc_id go only where their texts are linked or equal."""
    a, b, c = (" ".join(f"{x}{n}" for n in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (1, None), (1, ""), (1, a + " more"), (2, c), (3, c), (3, "few words"), (None, a), (4, b)]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs(rows), "").collect()]
    of_a = [x for x in got if x[0] == 1 and x[1] in (a, a + " more")]
    assert len(of_a) == 1
    assert sorted(set(got) - set(of_a), key=str) == sorted([(1, b), (1, None), (1, ""), (2, c), (3, "few words"), (None, a)], key=str) and len(got) == 7


def test_texts_that_stay_are_not_shuffled(spark, docs):
    """Few documents go and many stay: the ids of those that go are broadcast where those that stay are too many."""
    rows = [(i * 7919 % 100_003, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(1, 4000)] + [(200_000, "a5 b5 c5 d5 e5 f5"), (None, "a6 b6 c6 d6 e6 f6")]
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "8k")
    try:
        out = corpus_pipeline.near_copies(spark, docs(rows), "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(got, key=str) == sorted((r for r in rows if r[0] != 200_000), key=str)
