import random
import zlib

import numpy as np

from lakeval.llm import hdlang
from lakeval.llm.queries import op8_language_id

WORDS = {
    "en": "the and of to in is that for was with as his they this have from one had word but what some".split(),
    "de": "der die und das ist nicht ein eine mit auf für sich dem den auch werden wird über zwischen schön".split(),
    "ru": "и в не на что он с как это по но из у за вы так же от бы".split(),
}


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(8, 60))), lang, "s", 0))
    return out


def test_held_out_accuracy(spark, tmp_path):
    rows = [*texts(300), (1001, None, "en", "s", 0), (1002, "123 --- !", "de", "s", 0), (1003, "", None, "s", 0), (None, "the and of", "zz", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op8_language_id.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, _, lang, *_ in rows[:300]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[i]["lang_pred"], lang) for i, _, lang, *_ in rows[:300] if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1001, 1002, 1003))
    assert got[None]["lang_pred"] in WORDS  # nothing was learned from it
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_vectors_are_bundles_of_bound_rotations():
    made = hdlang.Profiles(dims=64)
    a, b, c, space = (made._letter(ord(x)) for x in "abc ")
    want = sum(x * np.roll(y, 1) * np.roll(z, 2) for x, y, z in ((space, a, b), (a, b, c), (b, c, space), (c, space, space)))
    got = made.text("ABC!?")
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-6)
    small = hdlang.Profiles(dims=64, most=3)
    assert np.allclose(small.text("ABC!?"), got)
    assert made.text("12") is None and made.text(None) is None


def test_nothing_learned(spark, docs):
    df = docs([(1, "some text"), (2, None)])
    out = hdlang.predict(df, {}).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}
    assert hdlang.learn(docs([])) == {} and hdlang.predict(docs([]), {}).count() == 0


def test_unlike_texts_leave_the_pipeline(spark):
    """Texts of a language that was not learned, gibberish and letter junk go; learned ones stay, with or without label."""
    import corpus_pipeline

    rng = random.Random(4)
    foreign = "kaj la estas en mi ne vi al por kun ili sed kiu tio ghi li shi plej chiuj tamen".split()
    planted = [(2000 + i, " ".join(rng.choice(foreign) for _ in range(60)), None, "s", 0) for i in range(5)]
    planted += [(2100 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(60)), None, "s", 0) for i in range(5)]
    planted += [(2200, "x" * 300, None, "s", 0), (2201, "x" * 100_000, None, "s", 0), (2202, "語" * 200, "en", "s", 0)]
    unlabelled = [(3000 + i, t, None, s, n) for i, t, _, s, n in texts(30, seed=9)]
    rows = [*texts(600), *planted, *unlabelled]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language(spark, df, "")
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == df.columns
    assert not kept & {r[0] for r in planted}
    assert {r[0] for r in unlabelled} <= kept and len(kept & set(range(600))) >= 597
