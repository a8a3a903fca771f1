"""Near-duplicate lines across documents, by a segment-partition edit join. DataFrame functions only.

Two lines within ``tau`` edits share a segment: cut the shorter one into ``tau + 1`` segments, and as many
edits leave one of them whole. A line looks for the segments of lines of its length and up to ``tau``
less, each at the few offsets that the edits on either side still allow (the multi-match-aware windows),
so its keys are hashes of ``(length, segment number, substring)``. What meets under a key is verified by a
banded bit-parallel automaton: for each number of errors a word holds the 2 tau + 1 diagonals that can
still lead to the end.

``tau`` edits are for lines of ``min_chars`` and more; shorter ones are allowed edits in proportion, down
to none, where lines are grouped by exact form. A pair is allowed the edits of its shorter line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..workspace import Workspace

TAU = 2
MIN_CHARS = 30
_WHITE = " \t\r\x0b\x0c"


def line_form(line: Column) -> Column:
    """A line as it is compared: without ASCII white space at its ends."""
    ends = [F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c)) for c in _WHITE]
    return F.when(reduce(Column.__or__, ends), F.btrim(line, F.lit(_WHITE))).otherwise(line)  # btrim goes over all of a line


def _with(values: dict[str, Column], use) -> Column:
    """``use`` of the values, each worked out once a row however often it is used."""
    held = F.array(F.struct(*(c.alias(n) for n, c in values.items())))
    return F.get(F.transform(held, lambda s: use(*(s[n] for n in values))), F.lit(0))


def _places(tau: int) -> list[tuple[int, int, int, int]]:
    """(edits, characters less, segment, shift) of each key of a line; its own segments are those at 0 less
    and shift 0."""
    out = []
    for less in range(tau + 1):
        for i in range(tau + 1):
            out += [(tau, less, i, shift) for shift in range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1)]
    return out


def _place_column(tau: int) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("tau", "less", "i", "shift"), p, strict=True))) for p in _places(tau)))


def _wide(form: Column) -> Column:
    """Four bytes a character, so that a segment is cut without walking over the characters before it."""
    return F.encode(form, "UTF-32")


def _key(wide: Column, place: Column) -> Column:
    """The key of a line at a place: a segment of it as a line of its length, or that much less, would be cut.
    The last segments take the characters that are over."""
    tau, less, i, shift = (place[n] for n in ("tau", "less", "i", "shift"))
    m = F.shiftright(F.octet_length(wide), 2) - less
    base, extra = F.call_function("div", m, tau + 1).cast("int"), m % (tau + 1)
    over = tau + 1 - i
    size = base + (extra >= over).cast("int")
    start = base * i + F.greatest(F.lit(0), extra - over) + shift
    return F.xxhash64(F.substring(wide, start * 4 + 1, size * 4), m, i, tau)


def segment_keys(form: Column, tau: int) -> Column:
    """Array of all keys of a line; it needs more than ``2 * tau + 1`` characters, so that every probe lies
    within the line."""
    return F.transform(_place_column(tau), lambda place: _key(_wide(form), place))


def within_edits(a: Column, b: Column, tau: int) -> Column:
    """Whether the edit distance of two strings (in code points) is at most ``tau``."""
    full = (1 << (2 * tau + 1)) - 1

    def step(state: Column, match: Column) -> Column:
        new: list[Column] = []
        for e in range(tau + 1):
            here = state.getField(f"e{e}")
            word = here.bitwiseAND(match)
            if e:
                less = state.getField(f"e{e - 1}")
                word = word.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(full))
            new.append(word)
        return F.struct(*(w.alias(f"e{e}") for e, w in enumerate(new)))

    begin = F.struct(*(F.lit(((1 << (e + 1)) - 1) << tau & full).alias(f"e{e}") for e in range(tau + 1)))

    def run(one: Column, two: Column) -> Column:
        def equal_at(c: Column, j: Column) -> Column:
            out = F.lit(0)
            for k in range(-tau, tau + 1):
                out = out + F.when(F.get(one, j + k) == c, 1 << (k + tau)).otherwise(0)
            return out

        return F.aggregate(F.transform(two, equal_at), begin, step, lambda s: s.getField(f"e{tau}"))

    last = _with({"x": F.split(a, ""), "y": F.split(b, "")}, run)
    gap = F.length(a) - F.length(b)
    return F.when(F.abs(gap) > tau, False).when(F.length(b) == 0, True).otherwise(F.call_function("shiftright", last, gap + tau).bitwiseAND(F.lit(1)) == 1)


def _spans(tau: int, min_chars: int) -> list[tuple[int, int, int]]:
    """(edits, least length, length from which more are allowed) of the lines that are allowed any."""
    least = [max(-(-e * min_chars // tau), 2 * e + 2) for e in range(1, tau + 1)]
    return [(e, low, high) for e, low, high in zip(range(1, tau + 1), least, [*least[1:], 1 << 30], strict=True)]


def line_keys(forms: DataFrame, tau: int, min_chars: int, least: int) -> DataFrame:
    """(key, tag) of the keys of lines, under the edits allowed to them and to lines that much shorter: own
    keys are tagged by the line's node, the other probes by ``-node - 1``.

    One row a place and one expression for all of them, as the JVM does not compile the code of a dozen."""
    spans = [(tau, 2 * tau + 2, 1 << 30)] if least >= min_chars or not tau else _spans(tau, min_chars)
    none, n = F.array().cast("array<struct<tau:int,less:int,i:int,shift:int>>"), F.col("n")
    places = F.concat(*(F.when((n >= low) & (n < high + e), _place_column(e)).otherwise(none) for e, low, high in spans))
    wide = forms.filter(n >= min(low for _, low, _ in spans)).select("node", "n", _wide(F.col("form")).alias("wide"))
    rows = wide.select("node", "wide", F.explode(places).alias("place"))  # a select of its own: once a line
    own = (F.col("place.less") == 0) & (F.col("place.shift") == 0)
    return rows.select(_key(F.col("wide"), F.col("place")).alias("key"), F.when(own, F.col("node")).otherwise(-F.col("node") - 1).alias("tag"))


def pieces_meet(a: Column, b: Column, tau: int, pieces: int = 8) -> Column:
    """Whether all but ``tau`` pieces of one string are in the other, as they are within ``tau`` edits: each
    edit changes one piece at most. Far cheaper than the automaton, and lets through few pairs that it refuses."""
    pieces = max(pieces, tau + 1)
    size = F.call_function("div", F.length(a), F.lit(pieces)).cast("int")
    found = sum((F.contains(b, F.substring(a, size * k + 1, size)).cast("int") for k in range(1, pieces)), F.contains(b, F.substring(a, F.lit(1), size)).cast("int"))
    return found >= pieces - tau


def linked(a: Column, b: Column, tau: int, min_chars: int, least: int) -> Column:
    """Whether two lines are within the edits allowed to the shorter one."""
    if least >= min_chars or not tau:
        return pieces_meet(a, b, tau) & within_edits(a, b, tau)
    n, out = F.least(F.length(a), F.length(b)), a == b
    for e, low, _ in _spans(tau, min_chars):
        out = F.when(n >= low, pieces_meet(a, b, e) & within_edits(a, b, e)).otherwise(out)
    return out


#: Classes of letters whose counts an edit changes by one or two in all; fixed values, any choice is right.
_CLASSES = ("e", "a", "i", "o", "u", "n", "t", "s", "r", "h", "d", "l", "cmpw", "bfgy", "jkqvxz", "0123456789")


def _counts(form: Column) -> list[Column]:
    """How many characters of each class a line has. All of a class are first made its first letter, in one
    pass; single ASCII letters are then counted by the bytes that go with them."""
    rest, first = "".join(c[1:] for c in _CLASSES), "".join(c[0] * (len(c) - 1) for c in _CLASSES)
    low = F.translate(F.lower(form), rest, first)
    return [(F.octet_length(low) - F.octet_length(F.replace(low, F.lit(c[0]), F.lit("")))).alias(f"c{k}") for k, c in enumerate(_CLASSES)]


def _lines(docs: DataFrame, least: int) -> DataFrame:
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    form = line_form(F.col("line"))
    return rows.select("doc_id", "pos", form.alias("form")).filter((F.octet_length("form") >= 4 * least) | (F.length("form") >= least)).withColumns({"h": F.xxhash64("form"), "g": F.xxhash64("form", F.lit(1))})


def _members(forms: DataFrame, ws: Workspace, tau: int, min_chars: int, least: int) -> DataFrame:
    """(key, node, own) of the keys under which a line's own segment meets another line.

    An own key is tagged by the line's node, a probe by ``-node - 1``, so the least and the greatest tag of
    a key, summed up before the shuffle, tell whether it is a segment and whether it has two tags."""
    tags = line_keys(forms, tau, min_chars, least)
    shared = ws.save(tags.groupBy("key").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).filter("high >= 0 and low != high").select("key"), "shared")
    # never a broadcast, which would only do for small tables; hashed, as few tags have a shared key: they needn't be sorted
    out = tags.join(shared.hint("shuffle_hash"), "key").select("key", F.when(F.col("tag") < 0, -F.col("tag") - 1).otherwise(F.col("tag")).alias("node"), (F.col("tag") >= 0).alias("own"))
    out = ws.save(out.groupBy("key", "node").agg(F.max("own").alias("own")), "members", release=True)
    ws.drop(shared)
    return out


def _groups(forms: DataFrame, ws: Workspace, tau: int, min_chars: int, least: int) -> DataFrame:
    """(node, component) of the lines that are linked to another.

    Each line is first verified against the least of the lines whose segment it holds. Keys whose lines are
    all in one group by then are settled. Under the others a segment's lines are joined with those that hold
    it, across groups only, and what the join lets through has like counts of letters; nothing else is
    written, so look-alike lines of one template don't become rows of pairs."""
    members = _members(forms, ws, tau, min_chars, least)
    texts = ws.save(forms.select("node", "form").join(members.select("node").distinct().hint("shuffle_hash"), "node", "left_semi"), "texts", release=True)
    a = texts.select(F.col("node").alias("a"), F.col("form").alias("fa"))
    b = texts.select(F.col("node").alias("b"), F.col("form").alias("fb"))

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.join(a, "a").join(b, "b").filter(linked(F.col("fa"), F.col("fb"), tau, min_chars, least)).select("a", "b")

    lead = members.filter("own").groupBy("key").agg(F.min("node").alias("lead"))
    stars = members.join(lead, "key").filter("node != lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    links = ws.save(verify(stars), "links")
    groups = ws.save(connected_components(links, ws), "groups")
    of = groups.select(F.col("node").alias("n"), "component")
    grouped = members.join(of, F.col("node") == F.col("n"), "left").select("key", "node", "own", F.coalesce("component", "node").alias("component"))
    mixed = grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    left = ws.save(grouped.join(mixed, "key").join(texts, "node").select("key", "node", "own", "component", F.length("form").alias("n"), *_counts(F.col("form"))), "left")
    if left.isEmpty():
        return groups
    i, p = left.filter("own").alias("i"), left.alias("p")
    apart = sum((F.abs(F.col(f"i.c{k}") - F.col(f"p.c{k}")) for k in range(1, len(_CLASSES))), F.abs(F.col("i.c0") - F.col("p.c0")))
    once = (F.col("i.n") < F.col("p.n")) | (F.col("i.n") == F.col("p.n")) & ((F.col("i.node") < F.col("p.node")) | ~F.col("p.own"))
    near = i.join(p, (F.col("i.key") == F.col("p.key")) & (F.col("i.component") != F.col("p.component")) & once & (apart <= 2 * tau))
    pairs = near.select(F.least("i.node", "p.node").alias("a"), F.greatest("i.node", "p.node").alias("b")).distinct()
    found = ws.save(verify(ws.save(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")), "links")
    if found.isEmpty():
        return groups
    return ws.save(connected_components(links.unionAll(found), ws), "groups")


def repeated_lines(docs: DataFrame, ws: Workspace, tau: int = TAU, min_chars: int = MIN_CHARS, least: int | None = None) -> DataFrame:
    """(doc_id, pos) of the lines that go: those with an earlier line in their group.

    Groups are lines reached from each other by steps of at most ``tau`` edits; earlier is by doc_id, then
    by place in the text. Equal lines are grouped by their characters, not by a digest. Lines from ``least``
    characters up (``min_chars`` if not given) take part, those under ``min_chars`` with fewer edits. An
    input without lines gives an empty table.
    """
    least = min_chars if least is None else least
    if min_chars <= 2 * tau + 1:
        raise ValueError("lines must be longer than twice the threshold and one")
    ws = ws.child("repeated")
    lines = _lines(docs, least)
    forms = lines.groupBy("h", "g", "form").agg(F.count("*").alias("copies"))
    forms = ws.save(forms.select(F.monotonically_increasing_id().alias("node"), "h", "g", "form", F.length("form").alias("n"), "copies"), "forms", release=True)
    groups = _groups(forms, ws, tau, min_chars, least)
    ws.keep(forms, groups)
    alike = forms.groupBy("h", "g").agg(F.count("*").alias("k")).filter("k > 1")
    by = ["h", "g"] if alike.isEmpty() else ["h", "g", "form"]  # 128 bits stand for a line unless two lines share them
    wanted = forms.select("node", "copies", *by).join(groups.hint("merge"), "node", "left").filter("copies > 1 or component is not null").select(*by, F.coalesce("component", "node").alias("component"))
    places = ws.save(lines.select("doc_id", "pos", *by).join(wanted.hint("shuffle_hash"), by).select("component", "doc_id", "pos"), "places", release=True)
    ws.keep(places)
    heads = places.groupBy("component").agg(F.min(F.struct("doc_id", "pos")).alias("head"))
    heads = heads.select("component", F.col("head.doc_id").alias("doc"), F.col("head.pos").alias("at"))
    return places.join(heads, "component").filter("doc_id > doc or (doc_id = doc and pos > at)").select("doc_id", "pos")


def dedup_lines(docs: DataFrame, ws: Workspace, tau: int = TAU, min_chars: int = MIN_CHARS, least: int | None = None) -> DataFrame:
    """``docs`` with each text less its repeated lines, and n_lines and n_removed.

    Lines are cut at line feeds. Shorter lines than ``least`` (ends trimmed; ``min_chars`` if not given)
    always stay, so with 1 only blank ones do; see ``repeated_lines`` for those between. A null text stays null with 0 lines. Rows that repeat a doc_id count as one document: a line at the same place of
    them is one line. A row with a null doc_id stays whole and makes no other line go. All other columns
    stay, but input columns named n_lines and n_removed are replaced. An empty table gives an empty one.
    """
    ws = ws.child("lines")
    docs = docs.drop("n_lines", "n_removed")
    cols = docs.columns
    gone = repeated_lines(docs, ws, tau, min_chars, least).groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    gone = ws.save(gone, "gone", release=True)
    ws.keep(gone)
    of, at = "of" + "_" * max(map(len, cols), default=0), "at" + "_" * max(map(len, cols), default=0)  # longer than any column of the input
    out = docs.join(gone.select(F.col("doc_id").alias(of), F.col("gone").alias(at)).hint("merge"), F.col("doc_id") == F.col(of), "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    rest = _with({"lines": lines, "kept": kept}, lambda x, k: F.array_join(F.transform(k, lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col(at).isNull() | F.col("text").isNull(), F.col("text")).otherwise(rest)
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.when(F.col(at).isNull() | F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    return out.select(*(c if c != "text" else text.alias("text") for c in cols), count.alias("n_lines"), removed.alias("n_removed"))
