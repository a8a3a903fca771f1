"""Personal data replaced by keyed surrogates of the same kind and format.

Detected are e-mail addresses, telephone numbers, IPv4 addresses, card numbers, US social security
numbers, IBANs, assigned secrets (``token = "..."``) and persons named after a form of address or by a
known given name. A surrogate keeps what can be read off the original: lengths, separators, letter case,
script, the check digit of a card or IBAN that had a right one, the country code of a telephone number,
the top-level domain, the gender of a given name or form of address.

Digits and letters go through a keyed permutation of all strings of their pattern (a Feistel network,
walked until it is inside the pattern's domain), so two entities never get one surrogate there. Names come
from syllables of their script and may meet. Either way all distinct entities of the corpus are checked
against each other: one whose surrogate is another's, or is itself an original, moves to its next
surrogate until none clashes. The same entity has the same surrogate in every document; a given name or
surname keeps its own, so a later mention of either part still points to the same person.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace, bound_batches

FEMALE = "Anna Maria Emma Sophie Julia Laura Sarah Lisa Marie Claire Camille Elena Carmen Lucia Mary Linda Susan Karen Nancy Helen Alice Jane Olga Irina Natalia Анна Мария Елена Ольга Ирина Наталья Татьяна Μαρία Ελένη Άννα".split()
MALE = "John James Robert Michael William David Richard Thomas Charles Daniel Paul Mark George Peter Hans Karl Jürgen Klaus Wolfgang Pierre Jean Michel Jacques Philippe José Juan Carlos Luis Miguel Javier Ivan Иван Сергей Дмитрий Алексей Андрей Михаил Γιώργος Νίκος Δημήτρης".split()
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Mme": "f", "Mlle": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}

_UP = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΫΆΈΉΊΌΎΏ]"
_LOW = r"[a-zß-öø-ÿа-яёά-ώ]"
_NAME = rf"{_UP}{_LOW}+(?:-{_UP}{_LOW}+)?"
_FIRST = "|".join(sorted(FEMALE + MALE, key=len, reverse=True))
PATTERN = re.compile(
    r"(?P<secret>(?<![\w])(?:token|secret|password|passwd|api_?key|access_?key)\s{0,3}[=:]\s{0,3}(?:(?P<quote>[\"'])(?P<quoted>(?:(?!(?P=quote))\S){12,})|(?P<bare>(?=[A-Za-z0-9+/_\-.=~]{12})[^\s\"'<>,;&(){}\[\]|]*[A-Za-z0-9+/_\-=~])))"
    r"|(?P<email>(?<![\w.+\-])[_.+\-]*+(?P<address>[^\W_][\w.+\-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w\-])))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<card>(?<![\w.\-+])(?:\d{13,19}|\d{4}(?P<sep>[ \-])\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7})(?![\w]|[.\-]\d))"
    r"|(?P<ssn>(?<![\w\-])(?!000|666)[0-8]\d\d-(?!00)\d\d-(?!0000)\d{4}(?![\w\-]))"
    r"|(?P<phone>(?<![\w.\-+])(?:\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w]|[.\-]\d))"
    rf"|(?P<titled>(?<!\w)(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?P<who>{_NAME}(?: {_NAME})?)(?!\w))"
    rf"|(?P<named>(?<!\w)(?P<given>{_FIRST}) (?P<surname>{_NAME})(?!\w))"
)
#: One of these stands in every match; a text without any needs no closer look.
_HINT = re.compile(rf"@|\d\d|[=:]|(?<!\w)(?:{'|'.join(TITLES)}|{_FIRST})(?!\w)")
_GENDER = {n.casefold(): g for g, names in (("f", FEMALE), ("m", MALE)) for n in names}


#: Letters and digits that a secret has at least; a line to fill in has none, and no surrogate.
LEAST_SECRET = 4
#: Strings beyond so many characters are permuted part by part.
PART = 1024


class _Key:
    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode()).digest()

    def number(self, *parts: object) -> int:
        data = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big")

    def permuted(self, n: int, domain: int, *label: object) -> int:
        """A permutation of range(domain) fixed by key and label."""
        half = max(1, (domain - 1).bit_length() + 1 >> 1)
        mask = (1 << half) - 1
        while True:
            left, right = n >> half, n & mask
            for r in range(6):
                left, right = right, left ^ (self._round(half, r, right, *label) & mask)
            n = left << half | right
            if n < domain:
                return n

    def _round(self, half: int, r: int, right: int, *label: object) -> int:
        out = self.number(r, right, *label)
        for more in range(1, -(-half // 128)):
            out = out << 128 | self.number(r, right, more, *label)
        return out


_DIGITS, _LOWER, _UPPER, _HEX, _HEXUP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF"


def _reshuffled(k: _Key, text: str, label: str, fixed: int = 0, hexes: bool = False) -> str:
    """Another string of the same pattern: digits to digits, letters to letters of their case, all else
    and the first ``fixed`` of them kept. Non-ASCII letters move within 32 neighbours of their alphabet's
    letters only when these are of the same category. Each part of a long string is permuted under a label
    that depends on all parts before it, so the whole is one to one as well."""
    if len(text) > PART:
        out, own = [], label
        for at in range(0, len(text), PART):
            out.append(_reshuffled(k, text[at : at + PART], own, max(0, fixed - at), hexes))
            own = f"{label}/{k.number(own, text[at : at + PART])}"
        return "".join(out)
    alphabet = []
    seen = 0
    for c in text:
        a = _HEX if hexes and c in _HEX else _DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else _neighbours(c)
        if len(a) > 1:
            seen += 1
            a = a if seen > fixed else c
        alphabet.append(a)
    domain, n = 1, 0
    for c, a in zip(text, alphabet, strict=True):
        domain, n = domain * len(a), n * len(a) + a.index(c)
    if domain == 1:
        return text
    pattern = "".join(a[0] if len(a) == 1 else {10: "0", 16: "h", 26: "a" if a is _LOWER else "A"}.get(len(a), "u") for a in alphabet)
    n = k.permuted(n, domain, label, pattern)
    out = []
    for a in reversed(alphabet):
        n, at = divmod(n, len(a))
        out.append(a[at])
    return "".join(reversed(out))


@functools.lru_cache(4096)
def _neighbours(c: str) -> str:
    if not c.isalpha():
        return c
    base = ord(c) & ~31
    same = [chr(x) for x in range(base, base + 32) if unicodedata.category(chr(x)) == unicodedata.category(c) and chr(x).isalpha()]
    return "".join(same) if c in same else c


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _card(k: _Key, digits: str, attempt: int) -> str:
    if _luhn(digits) == 0:  # the last digit follows from the others
        body = _walk(k, digits[:-1], "card", attempt, fixed=1)
        return body + next(c for c in _DIGITS if _luhn(body + c) == 0)
    out = digits
    for _ in range(attempt + 1):
        out = _reshuffled(k, out, "card-", fixed=1)
        while _luhn(out) == 0:
            out = _reshuffled(k, out, "card-", fixed=1)
    return out


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(k: _Key, text: str, attempt: int) -> str:
    body = _walk(k, text[4:], "iban" + text[:2], attempt)
    if _iban_rest(text) != 1:
        return text[:2] + _walk(k, text[2:4], "iban-check", attempt) + body
    return text[:2] + f"{98 - _iban_rest(text[:2] + '00' + body):02d}" + body


def _walk(k: _Key, text: str, label: str, attempt: int, fixed: int = 0, hexes: bool = False) -> str:
    for _ in range(attempt + 1):
        text = _reshuffled(k, text, label, fixed, hexes)
    return text


#: After so many clashes a name gets one syllable more, so no number of names fills the space.
LONGER = 4

_SYLLABLES = {
    "LATIN": ("b br c d dr f fl g gr h j k kl l m n p pr r s st t tr v w z".split(), "a e i o u ei au ie".split(), {"f": ["a", "ia", "elle", "ine"], "m": ["o", "en", "ric", "us"], "n": ["er", "man", "ley", "sen"]}),
    "CYRILLIC": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split(), {"f": ["а", "ия"], "m": ["ей", "ир", "ан"], "n": ["енко", "ук", "ич"]}),
    "GREEK": ("β γ δ ζ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο".split(), {"f": ["α", "η"], "m": ["ος", "ης"], "n": ["ακης", "ιδης"]}),
}


#: Endings of surnames that differ by gender, as (a man's, a woman's); Greek without accents.
_PAIRED = {
    "CYRILLIC": [("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ын", "ына"), ("ский", "ская"), ("цкий", "цкая")],
    "GREEK": [("ος", "ου"), ("ης", "η"), ("ας", "α")],
}


def _script(name: str) -> str:
    return unicodedata.name(name[0], "LATIN").split()[0]


def _bare(name: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", name) if c != "\u0301")) if _script(name) == "GREEK" else name


def surname_form(name: str) -> str:
    """The form that a family's members share: a man's, Greek ones without accents."""
    script, bare = _script(name), _bare(name)
    for his, hers in _PAIRED.get(script, ()):
        if bare.endswith(hers) and len(bare) > len(hers) + 2 and not (script == "GREEK" and bare.endswith(his)):
            return bare[: -len(hers)] + his
    return bare


def _ending(name: str) -> str:
    """The paired ending of a surname in a man's form; empty if it has none."""
    return next((his for his, _ in _PAIRED.get(_script(name), ()) if name.endswith(his) and len(name) > len(his) + 2), "")


def _name(k: _Key, name: str, kind: str, gender: str, attempt: int) -> str:
    script = _script(name)
    onset, vowel, endings = _SYLLABLES.get(script, _SYLLABLES["LATIN"])
    n = k.number(kind, gender, name.casefold(), attempt)
    out = ""
    for _ in range((2 if len(name) < 7 else 3) + attempt // LONGER):
        if n < 1 << 32:
            n = k.number(kind, gender, name.casefold(), attempt, len(out))
        n, a = divmod(n, len(onset))
        n, b = divmod(n, len(vowel))
        out += onset[a] + vowel[b]
    if n < 1 << 32:
        n = k.number(kind, gender, name.casefold(), attempt, len(out))
    n, a = divmod(n, len(onset))
    own = endings[gender if kind == "given" else "n"]
    out += onset[a] + (kind == "surname" and _ending(name) or own[n % len(own)])
    parts = [out[:1].upper() + out[1:]]
    if "-" in name:
        first, _, second = name.partition("-")
        parts = [_name(k, first, kind, gender, attempt), _name(k, second, kind, gender, attempt)]
    return "-".join(parts)


#: An entity: (kind, canonical form). Canonical forms leave out what does not tell entities apart.
Entity = tuple[str, str]


def surrogate(k: _Key, kind: str, form: str, attempt: int) -> str:
    """The replacement of an entity in canonical form; ``attempt`` counts the clashes before."""
    if kind == "email":
        local, _, domain = form.partition("@")
        labels = domain.split(".")
        return _walk(k, local, "local@" + domain, attempt) + "@" + ".".join([*(_walk(k, x, "domain", 0) for x in labels[:-1]), labels[-1]])
    if kind == "phone":
        country, _, rest = form.rpartition("/")
        return country + "/" + _walk(k, rest, "phone" + country, attempt)
    if kind == "ip":
        n = 0
        for x in form.split("."):
            n = n << 8 | int(x)
        for _ in range(attempt + 1):
            n = k.permuted(n, 1 << 32, "ip")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        return _card(k, form, attempt)
    if kind == "ssn":
        out = form
        for _ in range(attempt + 1):
            out = _reshuffled(k, out, "ssn")
            while out[:3] in ("000", "666") or out[0] == "9" or out[4:6] == "00" or out[7:] == "0000":
                out = _reshuffled(k, out, "ssn")
        return out
    if kind == "iban":
        return _iban(k, form, attempt)
    if kind == "secret":
        return _walk(k, form, "secret", attempt, hexes=all(c in _HEX for c in form))
    gender, _, name = form.partition("/")
    return gender + "/" + _name(k, name, kind, gender, attempt)


def _refit(shape: str, characters: str) -> str:
    """``characters`` in the places of the letters and digits of ``shape``."""
    it = iter(characters)
    return "".join(next(it, "") if c.isalnum() else c for c in shape)


def _cased(shape: str, text: str) -> str:
    """``text`` in upper case where ``shape`` is, letter by letter; beyond it as its last letter is."""
    if shape.islower() or len(shape) != len(text):
        return text if not shape.isupper() else text.upper()
    return "".join(t.upper() if s.isupper() else t for s, t in zip(shape, text, strict=True))


#: Calling codes of one and of two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")


def calling_code(digits: str) -> str:
    """The country's part of an international number."""
    return digits[:1] if digits.startswith(ONE_DIGIT) else digits[:2] if digits.startswith(TWO_DIGITS) else digits[:3]


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of what is to be replaced, in order and disjoint."""
    if not text or not _HINT.search(text):
        return []
    out: list[tuple[int, int, str, str]] = []
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if m["secret"]:
            group = "quoted" if m["quoted"] else "bare"
            if sum(c.isascii() and c.isalnum() for c in m[group]) >= LEAST_SECRET:
                out.append((*m.span(group), "secret", m[group]))
        elif m["email"]:
            out.append((*m.span("address"), "email", m["address"].lower()))
        elif m["iban"]:
            out.append((*m.span(), "iban", m["iban"].replace(" ", "")))
        elif m["ip"]:
            out.append((*m.span(), "ip", ".".join(str(int(x)) for x in m["ip"].split("."))))
        elif m["card"]:
            out.append((*m.span(), "card", re.sub(r"\D", "", m["card"])))
        elif m["ssn"]:
            out.append((*m.span(), "ssn", m["ssn"]))
        elif m["phone"]:
            digits = re.sub(r"\D", "", m["phone"])
            code = calling_code(digits) if m["phone"][0] == "+" else ""
            out.append((*m.span(), "phone", ("+" + code if code else "") + "/" + digits[len(code) :]))
        elif m["titled"]:
            start, parts = m.start("who"), m["who"].split(" ")
            gender = TITLES[m["title"]]
            if len(parts) == 2:
                own = _GENDER.get(parts[0].casefold(), gender)
                out.append((start, start + len(parts[0]), "given", own + "/" + parts[0]))
                start += len(parts[0]) + 1
            out.append((start, m.end("who"), "surname", "n/" + surname_form(parts[-1])))
        elif kind:
            out.append((*m.span("given"), "given", _GENDER[m["given"].casefold()] + "/" + m["given"]))
            out.append((*m.span("surname"), "surname", "n/" + surname_form(m["surname"])))
    return out + _later_mentions(text, out)


def _later_mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Other mentions of names that the text has in full somewhere."""
    known = {text[a:b]: (kind, form) for a, b, kind, form in found if kind in ("given", "surname")}
    for kind, form in list(known.values()):
        known.setdefault(form.partition("/")[2], (kind, form))
    if not known:
        return []
    taken = sorted(x[:2] for x in found)
    alike = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")(?!\w)")
    starts = [a for a, _ in taken]
    from bisect import bisect_right

    out = []
    for m in alike.finditer(text):
        at = bisect_right(starts, m.start()) - 1
        if at < 0 or taken[at][1] <= m.start():
            if at + 1 >= len(taken) or taken[at + 1][0] >= m.end():
                out.append((*m.span(), *known[m[0]]))
    return out


def written(kind: str, shape: str, value: str) -> str:
    """A surrogate in the format of the mention that it replaces."""
    if kind == "email":
        return _cased(shape, value)
    if kind == "phone":
        code, _, rest = value.rpartition("/")
        return _refit(shape, code.removeprefix("+") + rest)
    if kind in ("card", "iban"):
        return _refit(shape, value)
    if kind in ("given", "surname"):
        name = value.partition("/")[2]
        bare = _bare(shape)
        his = _ending(name)
        if kind == "surname" and his and surname_form(shape) != bare:  # a woman's form of it
            name = name[: -len(his)] + dict(_PAIRED[_script(name)])[his]
        return name
    return value


def _entities(docs: DataFrame, key: str) -> DataFrame:
    """(h, kind, form, made) of each text; ``h`` stands for the text."""

    def run(batches):
        k = _Key(key)
        for b in batches:
            rows = [(h, kind, form) for h, t in zip(b.column("h").to_pylist(), b.column("text"), strict=True) for kind, form in sorted({x[2:] for x in mentions(t.as_py())})]
            made = [surrogate(k, kind, form, 0) for _, kind, form in rows]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array(made, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "kind", "form", "made"])

    return docs.select("h", "text").mapInArrow(run, "h long, kind string, form string, made string")


def _redrawn(rows: DataFrame, key: str) -> DataFrame:
    def run(batches):
        k = _Key(key)
        for b in batches:
            made = [surrogate(k, x, f, n) for x, f, n in zip(b.column("kind").to_pylist(), b.column("form").to_pylist(), b.column("attempt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("form"), pa.array(made, pa.string()), b.column("attempt")], names=["kind", "form", "made", "attempt"])

    return rows.select("kind", "form", "made", "attempt").mapInArrow(run, "kind string, form string, made string, attempt int")


def _low(c: str) -> Column:
    """What a form or surrogate is compared by: without case, and names without the mark of their gender, as
    they are written."""
    named = F.col("kind").isin("given", "surname")
    return F.lower(F.when(named, F.substring_index(c, "/", -1)).otherwise(F.col(c)))


def resolve(seen: DataFrame, key: str, ws: Workspace, rounds: int = 50) -> DataFrame:
    """(kind, form, made, attempt) of the distinct entities, no two of a kind with one surrogate and none
    with a surrogate that is an original. Of those that clash the least form stays.

    Rounds go on until none clashes. Names get longer, so they end. Patterns of digits and letters end
    unless the corpus fills one whole, so that ``rounds`` rounds in a row bring no fewer clashes: then every
    entity of the kind goes back to its first surrogate, which no other has, though one may be an original."""
    table = ws.save(seen.select("kind", "form", "made").distinct().withColumn("attempt", F.lit(0)), "entities")
    originals = table.select("kind", _low("form").alias("low")).distinct()
    first = table
    fewest, stalled, full = None, 0, []
    while True:
        kinds = [F.col("kind"), _low("made").alias("low")]
        shared = table.groupBy(*kinds).agg(F.count("*").alias("n"), F.min("form").alias("least")).filter("n > 1").drop("n")
        taken = table.select(*kinds).distinct().join(originals, ["kind", "low"], "left_semi").withColumn("least", F.lit(None).cast("string"))
        clash = shared.unionByName(taken)
        if full:
            clash, taken = (d.filter(~F.col("kind").isin(*full)) for d in (clash, taken))
        marked = table.withColumn("low", _low("made")).join(clash, ["kind", "low"], "left_semi")
        again = marked.join(shared.withColumnRenamed("least", "stays"), ["kind", "low"], "left").join(taken.select("kind", "low", F.lit(True).alias("real")), ["kind", "low"], "left")
        again = ws.save(again.filter("real or form != stays").select("kind", "form", "made", (F.col("attempt") + 1).alias("attempt")), "again")
        left = again.count()
        if not left:
            return table
        stalled = 0 if fewest is None or left < fewest else stalled + 1
        fewest = left if fewest is None else min(fewest, left)
        if stalled >= rounds:
            spent = [r["kind"] for r in again.select("kind").distinct().collect() if r["kind"] not in ("given", "surname")]
            if spent:
                full += spent
                table = ws.save(table.filter(~F.col("kind").isin(*spent)).unionByName(first.filter(F.col("kind").isin(*spent))), "entities")
                fewest, stalled = None, 0
                continue
        kept = table.join(again.select("kind", "form"), ["kind", "form"], "left_anti")
        table = ws.save(kept.unionByName(_redrawn(again, key)), "entities")


def replace(docs: DataFrame, ws: Workspace, key: str, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """``docs`` with every mention of personal data replaced, and the number of mentions.

    Nulls and texts without personal data stay as they are. Equal texts, in repeated rows or documents,
    get equal replacements. Surrogates that had to move are found by a hash of the text; no id is read. Other
    columns stay, whatever their names; an input column named like the count is replaced; an empty table
    gives an empty one. The corpus's entities stay distributed throughout.
    """
    bound_batches(docs.sparkSession)
    seen = ws.save(_entities(docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text")), key), "seen", release=True)
    table = resolve(seen, key, ws)
    moved = table.filter("attempt > 0").select("kind", "form", "attempt")
    of_text = seen.join(moved, ["kind", "form"]).groupBy("h").agg(F.collect_set(F.struct("kind", "form", "attempt")).alias("moved"))
    docs = docs.drop(count)
    names = docs.columns
    of, moved_ = ("of" + "_" * (max(map(len, [*names, count])) + 1), "moved" + "_" * (max(map(len, [*names, count])) + 1))
    of_text = ws.save(of_text.select(F.col("h").alias(of), F.col("moved").alias(moved_)), "moved", release=True)
    if of_text.isEmpty():
        joined = docs.withColumn(moved_, F.lit(None).cast("array<struct<kind:string,form:string,attempt:int>>"))
    else:
        joined = docs.join(of_text, F.xxhash64(text) == F.col(of), "left")
    schema = T.StructType([*docs.schema.fields, T.StructField(count, T.LongType())])

    def run(batches):
        k = _Key(key)
        kept: dict[tuple[str, str, int], str] = {}
        for b in batches:
            texts, counts = [], []
            for t, moved in zip(b.column(text), b.column(moved_), strict=True):
                whole = t.as_py()
                found = sorted(mentions(whole))
                attempts = {(m["kind"], m["form"]): m["attempt"] for m in moved.as_py() or ()} if found else {}
                parts, at = [], 0
                for start, end, what, form in found:
                    who = (what, form, attempts.get((what, form), 0))
                    value = kept.get(who)
                    if value is None:
                        if len(kept) > 100_000:
                            kept.clear()
                        value = kept[who] = surrogate(k, *who)
                    parts += [whole[at:start], written(what, whole[start:end], value)]
                    at = end
                texts.append("".join([*parts, whole[at:]]) if found else whole)
                counts.append(len(found))
            made = {text: pa.array(texts, pa.string()), count: pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in schema.names], names=schema.names)

    return joined.select(*names, moved_).mapInArrow(run, schema)
