import re

import pytest

from lakeval.llm import surrogates as s
from lakeval.workspace import Workspace

KEY = "test"


def replaced(spark, rows, key=KEY):
    df = spark.createDataFrame(rows, "doc_id long, text string, moved_id long, n_replaced string")
    return {r["doc_id"]: r for r in s.replace(df, Workspace(spark, "t"), key).collect()}


def test_kinds_keep_their_format():
    k = s._Key(KEY)
    text = "call +49 170 1234567 or (212) 555-0198, A.Bc+1@Mail.Example.COM 10.2.3.4 4111 1111 1111 1111 078-05-1120 DE89 3704 0044 0532 0130 00 token = \"" + "0af3" * 10 + '"'
    kinds = {}
    for a, b, kind, form in s.mentions(text):
        out = s.written(kind, text[a:b], s.surrogate(k, kind, form, 0))
        kinds[kind] = (text[a:b], out)
        assert out != text[a:b]
        if kind != "ip":
            assert len(out) == len(text[a:b])
            assert re.sub(r"[A-Za-z0-9]", "x", out) == re.sub(r"[A-Za-z0-9]", "x", text[a:b])
    assert set(kinds) == {"phone", "email", "ip", "card", "ssn", "iban", "secret"}
    assert s._luhn(kinds["card"][1].replace(" ", "")) == 0 and kinds["card"][1][0] == "4"
    assert s._iban_rest(kinds["iban"][1].replace(" ", "")) == 1 and kinds["iban"][1].startswith("DE")
    assert re.fullmatch(r"[0-9a-f]{40}", kinds["secret"][1])
    assert kinds["email"][1].endswith(".COM") and all(0 <= int(x) < 256 for x in kinds["ip"][1].split("."))


def test_permutation_is_one_to_one():
    k = s._Key(KEY)
    for domain in (1, 2, 10, 97, 1000):
        assert sorted(k.permuted(n, domain, "x") for n in range(domain)) == list(range(domain))
    assert len({s._reshuffled(k, f"a{n:03d}", "y") for n in range(1000)}) == 1000


def test_names_keep_gender_script_and_person():
    k = s._Key(KEY)
    text = "Mrs. Anna Schmidt met John Miller. Schmidt left, John stayed. Иван Петров и Петров."
    by = {}
    for a, b, kind, form in s.mentions(text):
        by.setdefault(text[a:b], set()).add(s.written(kind, text[a:b], s.surrogate(k, kind, form, 0)))
    assert set(by) == {"Anna", "Schmidt", "John", "Miller", "Иван", "Петров"}
    assert all(len(v) == 1 for v in by.values())
    assert any(next(iter(by["Anna"])).endswith(e) for e in ("a", "elle", "ine"))
    assert re.fullmatch(r"[А-Яа-я]+", next(iter(by["Петров"])))


@pytest.mark.parametrize("text", [None, "", "plain words, 12 of them, version 3.0.1 of 2024-01-02", "x" * 100_000, "Licensed under CC BY-NC 4.0.", "The Mark of 1234567890123456789012"])
def test_clean_texts_stay(text):
    assert s.mentions(text) == []


def test_same_entity_same_surrogate_everywhere(spark):
    rows = [(1, "write a.b@x.example.com", 5, "z"), (2, "A.B@X.example.com or +1 (555) 111-2222", 5, "z"), (3, None, 5, "z"), (4, "", 5, "z"), (None, "+1 555 111 2222", 5, "z"), (1, "write a.b@x.example.com", 5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, moved_id long, n_replaced string")
    got = s.replace(df, Workspace(spark, "t"), KEY).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    mail = by[1]["text"].split()[1]
    assert by[2]["text"].split()[0].lower() == mail.lower() != "a.b@x.example.com"
    assert re.sub(r"\D", "", by[2]["text"].split(" or ")[1]) == re.sub(r"\D", "", by[None]["text"])
    assert (by[3]["text"], by[3]["n_replaced"], by[4]["text"]) == (None, 0, "") and by[2]["n_replaced"] == 2
    assert s.replace(df.limit(0), Workspace(spark, "t"), KEY).count() == 0


def test_clashes_are_resolved(spark, monkeypatch):
    """All distinct entities get distinct surrogates that are no originals, though draws clash at first."""
    forms = [f"10.0.0.{n}" for n in range(30)]
    made = {f: f"10.0.0.{n // 3}" for n, f in enumerate(forms)}
    seen = spark.createDataFrame([(n, "ip", f, made[f]) for n, f in enumerate(forms)], "doc_id long, kind string, form string, made string")
    out = s.resolve(seen, KEY, Workspace(spark, "t")).collect()
    assert len(out) == 30 and len({r["made"] for r in out}) == 30
    assert not {r["made"] for r in out} & set(forms)


def test_secrets_and_addresses_are_replaced_whole():
    k = s._Key(KEY)
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    long = "aB3" * 67
    for text, secret in [(f'token = "{long}"###', long), (f"token={jwt}. Next", jwt), (f"secret: '{jwt}==~'", jwt + "==~"), ('password = "p@ss!word#1234" x', "p@ss!word#1234"), (f"api_key={long}$tail9 x", long + "$tail9"), ("token=" + "f00d" * 5000, "f00d" * 5000)]:
        ((a, b, kind, form),) = s.mentions(text)
        assert (kind, form, text[a:b]) == ("secret", secret, secret)
        out = s.surrogate(k, kind, form, 0)
        assert len(out) == len(secret) and re.sub(r"[A-Za-z0-9]", "x", out) == re.sub(r"[A-Za-z0-9]", "x", secret)
        assert all(out[n : n + 20] != secret[n : n + 20] for n in range(0, len(out) - 20, 20))
    for before in ("-", "_", ".", "--.", "(", "x: +"):
        ((a, b, kind, form),) = s.mentions(f"{before}jane@example.com")
        assert (kind, form, a) == ("email", "jane@example.com", len(before))
    glued = "word" * 30 + "jane@example.com"
    assert [x[3] for x in s.mentions(glued)] == [glued]
    assert s.mentions("password: ____________ or secret = ----------------") == []
    assert s.mentions("a.b-c+" * 50_000) == []  # in time that grows with the text alone
    assert len({s._reshuffled(k, "a" * 1024 + f"{n:02d}", "y") for n in range(100)}) == 100


def test_names_get_longer_until_none_clashes(spark):
    """More rounds than ``rounds``, as long as each leaves fewer clashes."""
    k = s._Key(KEY)
    assert len(s._name(k, "Νίκας", "surname", "n", 40)) > len(s._name(k, "Νίκας", "surname", "n", 3)) + 10
    assert len({s._name(k, "Νίκας", "surname", "n", 200 + n) for n in range(50)}) == 50
    rows = [(n, "surname", f"n/Ν{n}", "n/Βαβάκης") for n in range(4000)]
    seen = spark.createDataFrame(rows, "doc_id long, kind string, form string, made string")
    out = s.resolve(seen, KEY, Workspace(spark, "t"), rounds=2).collect()
    assert len(out) == 4000 and len({r["made"] for r in out}) == 4000 and max(r["attempt"] for r in out) > 2


def test_one_number_has_one_surrogate_and_keeps_its_country():
    k = s._Key(KEY)
    seen = set()
    for text in ("+4930 1234567", "+49 30 1234567", "+49 (30) 123-4567", "+49-30-1234567"):
        ((a, b, kind, form),) = s.mentions(text)
        out = s.written(kind, text, s.surrogate(k, kind, form, 0))
        assert (kind, form) == ("phone", "+49/301234567") and out.startswith("+49") and re.sub(r"\d", "0", out) == re.sub(r"\d", "0", text)
        seen.add(re.sub(r"\D", "", out))
    assert len(seen) == 1
    assert [s.calling_code(x) for x in ("15551112222", "74951234567", "351211234567", "4930", "85212345678")] == ["1", "7", "351", "49", "852"]


def test_a_familys_forms_stay_one_family():
    k = s._Key(KEY)
    for text, names, ending in [("Иван Петров и Анна Петрова", ("Петров", "Петрова"), ("ов", "ова")), ("Господин Достоевский, Госпожа Достоевская", ("Достоевский", "Достоевская"), ("ский", "ская")), ("Νίκος Παπαδόπουλος, Μαρία Παπαδοπούλου", ("Παπαδόπουλος", "Παπαδοπούλου"), ("ος", "ου"))]:
        out = {text[a:b]: s.written(kind, text[a:b], s.surrogate(k, kind, form, 0)) for a, b, kind, form in s.mentions(text)}
        his, hers = out[names[0]], out[names[1]]
        assert his.endswith(ending[0]) and hers.endswith(ending[1]) and his[: -len(ending[0])] == hers[: -len(ending[1])] and his != names[0]
    assert s.surname_form("Schmidt") == "Schmidt" and s.surname_form("Ова") == "Ова"


def test_the_whole_replacement_against_brute_force(spark):
    """Every entity of a corpus is replaced by one surrogate of its own, which is no original, and all else
    stays; texts differ from what plain substitution makes of them in nothing."""
    import random

    rng = random.Random(4)
    people = [f"{g} {n}" for g in ("Anna", "John", "Иван", "Мария") for n in ("Schmidt", "Miller", "Петров", "Garcia")]
    makers = [lambda: rng.choice(people), lambda: f"u{rng.randrange(40)}@mail{rng.randrange(3)}.example.com", lambda: f"+49 30 {rng.randrange(10**6, 10**6 + 30)}", lambda: f"10.0.0.{rng.randrange(50)}", lambda: f"078-05-{rng.randrange(1100, 1130)}"]
    rows = []
    for i in range(120):
        rows.append((i if i % 9 else None, " / ".join(rng.choice(["then", "so", "and later"]) + " " + rng.choice(makers)() for _ in range(rng.randrange(5))), i, "x"))
    planted = s.surrogate(s._Key(KEY), "ssn", "078-05-1100", 0)  # an original that is another's first surrogate
    rows += rows[:5] + [(None, None, 1, "x"), (7, "", 1, "x"), (None, f"078-05-1100 and {planted}", 500, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, moved_id long, n_replaced string")
    got = sorted(((r["moved_id"], r["text"], r["n_replaced"]) for r in s.replace(df, Workspace(spark, "t"), KEY).collect()), key=str)
    entities = sorted({x[2:] for _, t, *_ in rows for x in s.mentions(t)})
    k, attempt = s._Key(KEY), dict.fromkeys(entities, 0)
    low = lambda kind, v: (kind, (v.rpartition("/")[2] if kind in ("given", "surname") else v).lower())
    originals = {low(*e) for e in entities}
    while True:
        made = {e: low(e[0], s.surrogate(k, *e, attempt[e])) for e in entities}
        owners = {}
        for e in entities:
            owners.setdefault(made[e], e)
        again = [e for e in entities if made[e] in originals or owners[made[e]] != e]
        if not again:
            break
        for e in again:
            attempt[e] += 1
    assert any(attempt.values()) and len(set(made.values())) == len(entities)
    want = []
    for _, t, n, _ in rows:
        out, at, count = "", 0, 0
        for a, b, kind, form in sorted(s.mentions(t)):
            out, at, count = out + t[at:a] + s.written(kind, t[a:b], s.surrogate(k, kind, form, attempt[kind, form])), b, count + 1
        want.append((n, None if t is None else out + t[at:], count))
    assert got == sorted(want, key=str)


def test_a_pattern_that_is_full(spark):
    """All values of a pattern are taken: surrogates stay distinct, though they are originals too."""
    k = s._Key(KEY)
    seen = spark.createDataFrame([("secret", f, s.surrogate(k, "secret", f, 0)) for f in "0123456789"], "kind string, form string, made string")
    out = s.resolve(seen, KEY, Workspace(spark, "t"), rounds=1).collect()
    assert len({r["made"] for r in out}) == 10
