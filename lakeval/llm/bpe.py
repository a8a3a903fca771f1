"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The nondeterministic machine has states ``(last token, trie node)``: it walks the vocabulary's byte trie,
and where a node spells a token that may follow the last one it also restarts at the root, having output
that token. Two tokens may follow each other when BPE leaves their concatenation as those two, and a
token sequence is the BPE of its bytes exactly when each adjacent pair is. So of the walks that end at a
position only one has a complete last token, and the machine is functional. ``LazyTransducer``
determinises it as input is seen: a deterministic state is the set of live walks, each with the tokens
not yet emitted; what all live walks agree on is emitted at once. A walk dies after at most the longest
token, which bounds the lookahead. States are numbered and kept in tables that are dropped when they
outgrow a bound, and a move is determinised when it was met some times; until then the nondeterministic
machine walks on from what was emitted, both as in lazy regular-expression automata.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..workspace import bound_batches

_ROOT = 0
_BESIDE = re.compile(r"\s | \s")
_START = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class LazyTransducer:
    """Bytes of one pretoken to token ids.

    ``max_states`` bounds the tables of deterministic states; beyond it they start afresh. In pieces
    of up to ``most_walked`` bytes a move is determinised when it is missed for the ``due``-th time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, most_walked: int = 64, due: int = 32):
        self.ranks, self.max_states, self.most_walked, self.due = ranks, max_states, most_walked, due
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._size = {r: len(b) for b, r in ranks.items()}
        self._shorter: dict[int, int] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._base = max(ranks.values(), default=0) + 1
        #: By ``a * _base + b``: a number each, as pairs would be looked through by the garbage collector.
        self._fits: dict[int, bool] = {}
        self._child: dict[int, int] = {}
        self._token_at: list[int] = [-1]
        for b, r in ranks.items():
            node = _ROOT
            for c in b:
                key = node << 8 | c
                nxt = self._child.get(key)
                if nxt is None:
                    nxt = self._child[key] = len(self._token_at)
                    self._token_at.append(-1)
                node = nxt
            self._token_at[node] = r
        self._grows = {k >> 8 for k in self._child}
        self._reset()

    # -- which tokens may follow each other

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or an unreachable token."""
        if token not in self._halves:
            parts = self._merge(self.bytes_of[token], token)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Tokens of ``data`` by merges of a rank under ``below``, lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _reachable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._split(token) is not None

    def _follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves the bytes of a and b as exactly these two tokens.

        Both tokens' merges are undone from the latest back. At each step the tokens next to the
        boundary stand side by side until the earlier-undone merge ``until`` (for the right side
        inclusive, as of equal ranks the left goes first); a merge across the boundary of a lower rank
        would have come first."""
        key = a * self._base + b
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._reachable(b) and (a == _START or self._boundary_holds(a, b))
        return known

    def _boundary_holds(self, a: int, b: int) -> bool:
        until: float = float("inf")
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < until:
                return False
            left, right = self._split(a), self._split(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                until, a = a, left[1]
            else:
                until, b = b + 1, right[0]

    # -- deterministic states

    def _reset(self) -> None:
        self._ids: dict = {}
        self._walks: list = []
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._missed: dict[int, int] = {}
        self._state(((_START, _ROOT, ()),), ())

    def _state(self, live: tuple, final: tuple[int, ...]) -> int:
        key = (live, final)
        state = self._ids.get(key)
        if state is None:
            state = self._ids[key] = len(self._walks)
            self._walks.append(key)
        return state

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live: list[tuple[int, int, tuple[int, ...]]] = []
        final: tuple[int, ...] = ()
        child, token_at, fits, grows = self._child.get, self._token_at, self._fits.get, self._grows
        for last, node, owed in self._walks[state][0]:
            nxt = child(node << 8 | byte)
            if nxt is None:
                continue
            if nxt in grows:
                live.append((last, nxt, owed))
            token = token_at[nxt]
            if token >= 0:
                ok = fits(last * self._base + token)
                if self._follows(last, token) if ok is None else ok:
                    final = (*owed, token)
                    live.append((token, _ROOT, final))
        common: tuple[int, ...] = ()
        if live[0][2]:  # the oldest walk owes least
            n, low, high = 0, min(w[2] for w in live), max(w[2] for w in live)
            for x, y in zip(low, high, strict=False):
                if x != y:
                    break
                n += 1
            if n:
                common, final = low[:n], final[n:]
                live = [(a, b, owed[n:]) for a, b, owed in live]
        out = self._moves[state << 8 | byte] = (self._state(tuple(live), final), common)
        return out

    # -- the nondeterministic machine

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, -1 if there is none."""
        out = self._shorter.get(token)
        if out is None:
            data = self.bytes_of[token]
            found = (self.ranks.get(data[:n]) for n in range(len(data) - 1, 0, -1))
            out = self._shorter[token] = next((r for r in found if r is not None), -1)
        return out

    def _walk(self, piece: bytes, out: list[int]) -> list[int]:
        """Ids of a piece that begin with ``out``, by its one complete walk, searched longest token first. A
        place from which the end was not reached is not tried again: the tokens up to it are the same however
        it is reached."""
        child, token_at, fits, base, size, n = self._child.get, self._token_at, self._fits.get, self._base, self._size, len(piece)
        dead: set[int] = set()
        at, last, token = sum(map(size.__getitem__, out)), out[-1] if out else _START, -1
        while True:
            if token < 0:
                node: int | None = _ROOT
                for byte in piece[at:]:
                    node = child(node << 8 | byte)
                    if node is None:
                        break
                    if token_at[node] >= 0:
                        token = token_at[node]
            end = at + size[token]
            ok = fits(last * base + token)
            if (self._follows(last, token) if ok is None else ok) and end not in dead:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, -1
                continue
            token = self._prefix(token)
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else _START
                token = self._prefix(token)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pretoken; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._walks) > self.max_states:
            self._reset()
        out: list[int] = []
        state, known = 0, self._moves.get
        for byte in piece:
            step = known(state << 8 | byte)
            if step is None:
                if len(piece) <= self.most_walked:
                    key = state << 8 | byte
                    times = self._missed[key] = self._missed.get(key, 0) + 1
                    if times < self.due:
                        if len(self._missed) > 2 * self.max_states:
                            self._missed.clear()
                        return self._walk(piece, out)
                if len(self._walks) > 2 * self.max_states:  # within one very long piece
                    here = self._walks[state]
                    self._reset()
                    state, known = self._state(*here), self._moves.get
                step = self._move(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        out += self._walks[state][1]
        return out


class _Units(dict):
    """Text units to their packed ids, made when first asked for. Two generations of up to ``most`` are
    kept: when the young one is full it becomes the old one, and units still in use come back from it."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.make(unit)
        if len(unit) <= 48:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


_PROPERTY = re.compile(r"\\(p\{[A-Z][a-z]?\}|s|S)|\\.|[\[\]]", re.DOTALL)
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """``pattern`` for ``re``, which is faster, with its properties written out as ranges of the characters up
    to U+FFFF that ``regex`` finds to have them; None if it holds escapes or flags that are not known here."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    of: dict[str, str] = {}

    def ranges(name: str) -> str:
        if name not in of:
            runs = [m.group() for m in regex.finditer(rf"\{name}", every)]
            of[name] = "".join(f"\\u{ord(a):04x}-\\u{ord(b):04x}" for a, b in _runs(runs))
        return of[name]

    out, at, inside = [], 0, False
    for m in _PROPERTY.finditer(pattern):
        out.append(pattern[at : m.start()])
        at, what = m.end(), m.group()
        if what == "[":
            if inside:
                return None
            inside = True
        elif what == "]":
            inside = False
        elif what == r"\S" and not inside:
            what = f"[^{ranges('s')}]"
        elif m.group(1) and what != r"\S":
            what = ranges(m.group(1)) if inside else f"[{ranges(m.group(1))}]"
        elif what not in (r"\r", r"\n", r"\t"):
            return None
        out.append(what)
    return None if re.search(r"\(\?[^:!=]", pattern) else re.compile("".join([*out, pattern[at:]]))


def _runs(found: list[str]) -> list[tuple[str, str]]:
    """First and last of each run of characters that follow each other."""
    out: list[tuple[str, str]] = []
    for c in found:
        if out and ord(out[-1][1]) + 1 == ord(c):
            out[-1] = out[-1][0], c
        else:
            out.append((c, c))
    return out


class Encoder:
    """Text to packed ids: pretokens by ``pattern``, each through the transducer.

    A text without characters beyond U+FFFF is cut into pretokens at once by ``plain_pattern``. For others,
    where ``cut_spaces`` holds, as it does for patterns whose matches hold a space only in front or
    among white space, a text is first cut before each space that has no white space next to it; no
    pretoken crosses such a cut. Frequent units and pretokens are kept, up to ``most`` in all."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cut_spaces: bool = True, most: int = 210_000):
        machine = LazyTransducer(ranks)
        find = regex.compile(pattern).findall
        plain = plain_pattern(pattern)
        self.find = plain and plain.findall

        def piece_ids(piece: str) -> bytes:
            return struct.pack(f"<{len(ids := machine.encode_piece(piece.encode()))}I", *ids)

        def unit_ids(unit: str) -> bytes:
            found = find(unit)
            return piece_ids(unit) if len(found) == 1 else b"".join(map(piece, found))

        self.bytes_of = machine.bytes_of
        self.pieces = _Units(piece_ids, most if self.find else most // 4)
        piece = self.pieces.__getitem__
        self.units = _Units(unit_ids, most // 4 if self.find else most)
        self.cut_spaces = cut_spaces

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; a null is an empty text."""
        if not text:
            return b""
        if self.find and not _BEYOND.search(text):
            return b"".join(map(self.pieces.__getitem__, self.find(text)))
        if not self.cut_spaces:
            return self.units.make(text)
        parts = text.split(" ")
        units = [parts[0], *map(" ".__add__, parts[1:])]
        if _BESIDE.search(text):
            units = self._joined(parts)
        return b"".join(map(self.units.__getitem__, units))

    @staticmethod
    def _joined(parts: list[str]) -> list[str]:
        """Units where white space stands beside some of the spaces; there, nothing is cut."""
        out = [parts[0]]
        for before, p in zip(parts, parts[1:], strict=False):
            if p and before and not p[0].isspace() and not before[-1].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out


class StreamDecoder:
    """Ids to bytes and text, in chunks of any size.

    The state is the incomplete UTF-8 sequence at the end of what was fed. It is at most three bytes, so one
    look at the end of a chunk's bytes gives the next. ``text`` replaces bytes that belong to no character by
    U+FFFD."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.state = b""

    @staticmethod
    def _incomplete(data: bytes) -> int:
        """Length of the unfinished character at the end of ``data``."""
        for back in range(1, min(3, len(data)) + 1):
            c = data[-back]
            if c & 0xC0 != 0x80:
                need = 2 if c & 0xE0 == 0xC0 and c > 0xC1 else 3 if c & 0xF0 == 0xE0 else 4 if 0xF0 <= c <= 0xF4 else 1
                return back if need > back else 0
        return 0

    def feed(self, ids: Iterable[int]) -> bytes:
        """Bytes of the characters that these ids complete."""
        data = self.state + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data) - self._incomplete(data)
        self.state = data[cut:]
        return data[:cut]

    def flush(self) -> bytes:
        """What is left when the stream ends: an unfinished character's bytes."""
        rest, self.state = self.state, b""
        return rest

    def text(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of the chunks' ids as it becomes complete; an empty chunk gives an empty string, and what is
        unfinished at the end is replaced."""
        for ids in chunks:
            yield self.feed(ids).decode("utf-8", "replace")
        yield self.flush().decode("utf-8", "replace")


_MADE: dict = {}


def _once(key, make):
    """One machine a Python worker."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def _replaced(batch: pa.RecordBatch, names: list[str], values: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values[n] if n in values else batch.column(n) for n in names], names=names)


def _with(schema: T.StructType, **new: T.DataType) -> T.StructType:
    """``schema`` with columns replaced or added; a new column takes the place of one of its name."""
    return T.StructType([f for f in schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in new.items()])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """Add the ids of each whole text as little-endian unsigned 32-bit integers, and their number.

    Nulls and empty texts have no ids; repeated rows are each encoded; an input column named like an
    output is replaced; an empty table gives an empty table. The vocabulary (fixed in size, about 1 MB)
    is broadcast, so executors need no file of their own."""
    with open(ranks_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    key = ranks_path
    bound_batches(df.sparkSession)
    schema = _with(df.schema, **{ids: T.BinaryType(), count: T.LongType()})

    def run(batches):
        encoder = _once(("enc", key, pattern), lambda: Encoder(parse_ranks(data.value), pattern))
        for batch in batches:
            out, n = [], []
            for t in batch.column(text):
                got = encoder.encode(t.as_py())
                n.append(len(got) // 4)
                out.append(got)
            yield _replaced(batch, schema.fieldNames(), {ids: pa.array(out, pa.binary()), count: pa.array(n, pa.int64())})

    return df.mapInArrow(run, schema)


def _decoded(decoder: StreamDecoder, ids: bytes, chunk: int) -> bytes:
    numbers = np.frombuffer(ids, "<u4").tolist()
    parts = [decoder.feed(numbers[i : i + chunk]) for i in range(0, len(numbers), chunk)]
    return b"".join([*parts, decoder.flush()])


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", decoded: str = "decoded", chunk: int = 4096) -> DataFrame:
    """What ``encode`` adds, and the bytes that ``decode`` makes of it, in one pass of one worker: the streaming
    decoder reads the packed ids as anyone else would. Nulls and empty texts have no ids and no bytes; input
    columns named like an output are replaced; an empty table gives an empty table."""
    with open(ranks_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    key = ranks_path
    bound_batches(df.sparkSession)
    schema = _with(df.schema, **{ids: T.BinaryType(), count: T.LongType(), decoded: T.BinaryType()})

    def run(batches):
        encoder = _once(("enc", key, pattern), lambda: Encoder(parse_ranks(data.value), pattern))
        decoder = StreamDecoder(encoder.bytes_of)
        for batch in batches:
            out, n, back = [], [], []
            for t in batch.column(text):
                got = encoder.encode(t.as_py())
                n.append(len(got) // 4)
                out.append(got)
                back.append(_decoded(decoder, got, chunk))
            yield _replaced(batch, schema.fieldNames(), {ids: pa.array(out, pa.binary()), count: pa.array(n, pa.int64()), decoded: pa.array(back, pa.binary())})

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", decoded: str = "decoded", chunk: int = 4096) -> DataFrame:
    """Add the bytes that the ids spell, through the streaming decoder, ``chunk`` ids at a time.

    A null is no ids and gives empty bytes."""
    with open(ranks_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    key = ranks_path
    bound_batches(df.sparkSession)
    schema = _with(df.schema, **{decoded: T.BinaryType()})

    def run(batches):
        bytes_of = _once(("dec", key), lambda: {r: b for b, r in parse_ranks(data.value).items()})
        decoder = StreamDecoder(bytes_of)
        for batch in batches:
            out = []
            for v in batch.column(ids):
                out.append(_decoded(decoder, v.as_py() or b"", chunk))
            yield _replaced(batch, schema.fieldNames(), {decoded: pa.array(out, pa.binary())})

    return df.mapInArrow(run, schema)
