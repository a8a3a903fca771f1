import hashlib
import unicodedata

from pyspark.sql import functions as F

from lakeval.llm import fingerprint
from lakeval.llm.queries import op5_fingerprints


def canonical(t):
    n = unicodedata.normalize
    return " ".join(n("NFKC", n("NFKC", t or "").casefold()).split())


ODD = [(901, "ﬁne STRASSE"), (902, "fine  straße\n"), (903, "Å Å"), (904, "å å"), (905, "İ"), (906, " a b\x85"), (907, "A B")]


def test_equal_exactly_when_canonical_forms_are(spark, docs, corpus, ws):
    rows = [*corpus, *ODD, (None, "x y"), (None, "X  Y")]
    got = fingerprint.fingerprints(docs(rows), "doc_id", ["text"], ws, [F.col("text")]).collect()
    pairs = {(canonical(r["text"]), r["text_fp"]) for r in got}
    assert len(got) == len(rows)
    assert len(pairs) == len({c for c, _ in pairs}) == len({f for _, f in pairs})


def test_forms_that_share_a_hash_are_told_apart(spark, docs, ws, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda form: F.lpad(F.length(form).cast("string"), 32, "0"))
    rows = [(1, "aa"), (2, "bb"), (3, "AA"), (4, "c"), (5, None), (6, "")]
    got = {r["doc_id"]: r["text_fp"] for r in fingerprint.fingerprints(docs(rows), "doc_id", ["text"], ws).collect()}
    assert got[1] == got[3] != got[2] and got[5] == got[6] and len(set(got.values())) == 4


def test_query_equals_brute_force(spark, docs, corpus, tmp_path):
    rows = [*{i: (i, t) for i, t in corpus}.values()]
    rows.sort()
    docs(rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op5_fingerprints.query(spark, str(tmp_path)).collect()}
    texts = [t or "" for _, t in rows]
    prints = [got[i]["fingerprint"] for i, _ in rows]
    for k, (i, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(canonical(edited) == canonical(t))
        assert r["near_next"] == float(prints[k] == prints[(k + 1) % len(rows)])


def test_empty_and_single(spark, docs, tmp_path):
    for n in (0, 1):
        docs([(4, "abcd")][:n]).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        assert op5_fingerprints.query(spark, f"{tmp_path}/{n}").count() == n
