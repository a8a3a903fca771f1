"""Suffix dedup: bytes covered by a long string that an earlier document holds too.

Positions are named by the bucket of the string that starts there. The first buckets are single bytes;
the bucket of 2k bytes at ``p`` is made from the buckets of k bytes at ``p`` and at ``p + k``, up to
``gram_of(window)`` bytes (32 for 50), and that of the whole ``window`` from some of those: bucket pointers to
later offsets refine each level from the one before. Names are 64-bit and depend on the bytes alone, so documents need not
meet for this.

Only some of the positions have to meet. A window belongs to the least gram name that starts in it,
and so does every equal window elsewhere. Adjacent windows of one such leader are a run, one for about 10
positions at a window of 50. Grams are as long as that allows: texts that aren't copies share many short ones,
and the more the larger the corpus is, and all of their runs would go on to round 3. Buckets of leaders are refined in three rounds, each between batches of documents and shards
of leaders:

1. Which leaders stand in two documents or more? All others are settled.
2. Of those, runs are sorted by leader and by name of the whole run: a run whose equal stands in an
   earlier document goes as a whole. A leader whose runs are all equal is settled.
3. What is left, the first run of each name where a leader has several names, goes to the leader's shard with
   its bytes. There buckets of 8-grams are refined by sorting positions on the buckets of later offsets until
   a bucket is a whole window (``refined``), so what is removed here is equal byte by byte.

A batch sends each name once, with its least doc_id, so a passage that a third of all documents share
costs a batch one entry. Leaders with very many names are dealt out by window in round 3.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

GRAM = 16
MOST_RUN = 32
BATCH_BYTES = 6 << 20
SHARD_BYTES = 16 << 20
#: Positions named together.
BLOCK = 1 << 14
#: Leaders with more distinct runs than this have their windows dealt out one by one.
HOT_NAMES = 20_000
#: Runs whose windows a task refines together, beyond a whole leader's.
CHUNK_RUNS = 10_000

_RNG = np.random.Generator(np.random.Philox(key=[19, 73]))
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]

_RUN = np.dtype([("a", "<u8"), ("u", "<u8"), ("d", "<i8")])
_FLAG = np.dtype([("u", "<u8"), ("f", "u1")])
_MASK = np.dtype([("u", "<u8"), ("m", "<u4")])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _K[1]
    h ^= h >> np.uint64(27)
    h *= _K[2]
    h ^= h >> np.uint64(31)
    return h


def gram_of(window: int) -> int:
    """Bytes of a leader: the largest power of two up to two thirds of the window, 16 at least."""
    return max(GRAM, 1 << (2 * window // 3).bit_length() - 1)


def most_run(window: int) -> int:
    """Windows of a run: as many as can hold one place of a leader, 16 at least. Periodic texts have longer ones."""
    return min(MOST_RUN, max(16, window - gram_of(window) + 1))


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Names of the grams at each position, by doubling."""
    h, k = _BYTE[data], 1
    while k < gram:
        h = h[:-k] * (_K[k.bit_length() % 4] | np.uint64(1)) + h[k:] if len(h) > k else h[:0]
        k *= 2
    return h


def _least(h: np.ndarray, wide: int) -> np.ndarray:
    """The least of the ``wide`` names from each position on."""
    least, span = h, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (wide - span)], least[wide - span :]) if span < wide else least


def _begins(values: np.ndarray) -> np.ndarray:
    """Where a value of a sorted column stands for the first time."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _windows(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Names of the windows at ``at``: grams at later offsets, the last one overlapping."""
    out, gram = np.zeros(len(at), np.uint64), gram_of(window)
    offsets = [*range(0, window - gram, gram), window - gram]
    for o in offsets:
        out = out * _K[0] + h[at + o]
        out ^= out >> np.uint64(29)
    return _mixed(out)


class Batch:
    """Documents laid end to end, and the runs of windows of one leader.

    Names are made some ten thousand positions at a time, so that the steps of one block stay in the
    processor's cache; only the grams (if ``named``) and the runs are kept of the whole batch."""

    def __init__(self, table: pa.Table, window: int, named: bool = True):
        self.window = window
        table = table.sort_by([("doc_id", "ascending")])
        self.ids = table.column("doc_id").to_numpy()
        raw = [t.as_py() or b"" for t in table.column("data")]
        self.lengths = np.array([len(t) for t in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.h = np.empty(max(0, len(self.data) - gram_of(window) + 1) if named else 0, np.uint64)
        none = np.empty(0, np.int64)
        self.lo, self.n, self.leader, self.doc = none, none, np.empty(0, np.uint64), none
        self.name = np.empty(0, np.uint64)
        if len(self.data) >= window:
            self._runs(named)

    def _runs(self, named: bool) -> None:
        total, most = len(self.data) - self.window + 1, most_run(self.window)
        windows = np.maximum(self.lengths - self.window + 1, 0)
        parts = np.stack([windows, self.lengths - windows], axis=1).reshape(-1)
        whole = np.repeat(np.arange(len(parts)) % 2 == 0, parts)[:total]  # the window lies within one document
        at, leaders, last = [], [], np.zeros(1, np.uint64)
        for lo in range(0, total, BLOCK):
            hi = min(lo + BLOCK, total)
            h = _grams(self.data[lo : hi + self.window - 1], gram_of(self.window))
            if named:
                self.h[lo : lo + len(h)] = h
            least = _least(_mixed(h), self.window - gram_of(self.window) + 1)
            edge = np.empty(hi - lo, bool)
            np.not_equal(least[1:], least[:-1], out=edge[1:])
            edge[0] = not lo or least[0] != last[0]
            edge[0] |= bool(lo) and whole[lo] != whole[lo - 1]
            edge[1:] |= whole[lo + 1 : hi] != whole[lo : hi - 1]
            first = np.flatnonzero(edge)
            at.append(first + lo)
            leaders.append(least[first])
            last = least[-1:].copy()
        first, lead = np.concatenate(at), np.concatenate(leaders)
        n, inside = np.diff(np.r_[first, total]), whole[first]
        first, lead, n = first[inside], lead[inside], n[inside]
        pieces = -(-n // most)
        if len(n) and pieces.max() > 1:
            step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
            first, lead, n = np.repeat(first, pieces) + step, np.repeat(lead, pieces), np.minimum(np.repeat(n, pieces) - step, most)
        self.lo, self.n, self.leader = first, n, lead
        self.doc = self.ids[np.searchsorted(self.starts + self.lengths, first, "right")]
        if named:
            ends = _windows(self.h, self.lo, self.window) * _K[0] + _windows(self.h, self.lo + self.n - 1, self.window)
            self.name = _mixed((ends ^ self.leader) * _K[3] + self.n.astype(np.uint64))

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each run name, in their order, a run of its least doc_id; and for each run the place of its name."""
        order = np.argsort(self.name)
        new = _begins(self.name[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        # runs stand in the order of doc_id, so the first one has the least
        return np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order, place

    def leaders_met(self, shared: np.ndarray) -> np.ndarray:
        """Whether each run's leader is shared with other batches, or by two documents of this one."""
        if not len(self.leader):
            return np.empty(0, bool)
        order = np.argsort(self.leader)
        a, d = self.leader[order], self.doc[order]
        start = np.flatnonzero(_begins(a))
        met = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
        if len(shared):
            shared = np.sort(shared)
            met |= shared[np.minimum(np.searchsorted(shared, a[start]), len(shared) - 1)] == a[start]
        out = np.empty(len(order), bool)
        out[order] = np.repeat(met, np.diff(np.r_[start, len(order)]))
        return out

    def hot_windows(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Route and name of the windows of a run, each as a run of its own."""
        names = _windows(self.h, np.arange(self.lo[run], self.lo[run] + self.n[run]), self.window)
        route = _mixed(names ^ self.leader[run])
        return route, _mixed(names * _K[3] + self.leader[run])


def _deal(src: int, route: np.ndarray, rows: np.ndarray, shards: int) -> pa.Table:
    """Packed rows for each shard of their routes."""
    to = (route >> np.uint64(40)) % np.uint64(shards)
    to = to.astype(np.uint16) if shards <= 1 << 16 else to  # short numbers are sorted by their digits
    order = np.argsort(to, kind="stable")
    dest, start = np.unique(to[order], return_index=True)
    parts = np.split(rows[order], start[1:]) if len(dest) else []
    return _table(dest.astype(np.int64), np.full(len(dest), src, np.int64), parts)


def _table(to: np.ndarray, src: np.ndarray, parts: list[np.ndarray]) -> pa.Table:
    return pa.table({"to": pa.array(to, pa.int64()), "src": pa.array(src, pa.int64()), "data": pa.array([p.tobytes() for p in parts], pa.binary())})


def _unpack(t: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows of packed tables and where each came from."""
    parts = [np.frombuffer(d.as_py(), kind) for d in t.column("data")]
    if not parts:
        return np.empty(0, kind), np.empty(0, np.int64)
    return np.concatenate(parts), np.repeat(t.column("src").to_numpy(), [len(p) for p in parts])


def _back(shard: int, src: np.ndarray, rows: np.ndarray) -> pa.Table:
    order = np.argsort(src, kind="stable")
    dest, start = np.unique(src[order], return_index=True)
    parts = np.split(rows[order], start[1:]) if len(dest) else []
    return _table(dest, np.full(len(dest), shard, np.int64), parts)


_PACKED = "to long, src long, data binary"


def _runs_dtype(window: int) -> np.dtype:
    return np.dtype([("r", "<u8"), ("u", "<u8"), ("d", "<i8"), ("n", "u1"), ("t", "u1", (window + most_run(window) - 1,))])


def _shared_leaders(t: pa.Table) -> pa.Table:
    a, src = _unpack(t, np.dtype("<u8"))
    order = np.argsort(a)
    a, src = a[order], src[order]
    same = a[1:] == a[:-1]
    met = np.r_[False, same] | np.r_[same, False]
    return _back(0, src[met], a[met])


def _resolved_runs(t: pa.Table) -> pa.Table:
    rows, src = _unpack(t, _RUN)
    order = np.lexsort((rows["d"], rows["u"], rows["a"]))
    rows, src = rows[order], src[order]
    a, u, d = rows["a"], rows["u"], rows["d"]
    new_a = np.r_[True, a[1:] != a[:-1]][: len(a)]
    new_u = (new_a | np.r_[True, u[1:] != u[:-1]][: len(a)])[: len(a)]
    group = np.cumsum(new_u) - 1
    least = d[np.flatnonzero(new_u)][group] if len(a) else d
    of_a = np.cumsum(new_a) - 1
    names = np.bincount(of_a, weights=new_u, minlength=1)[of_a] if len(a) else np.empty(0)
    flag = np.where(least < d, 1, np.where(names > HOT_NAMES, 4, np.where(names > 1, 2, 0))).astype(np.uint8)
    out = np.empty(len(a), _FLAG)
    out["u"], out["f"] = u, flag
    return _back(0, src[flag > 0], out[flag > 0])


def refined(texts: np.ndarray, window: int) -> np.ndarray:
    """Bucket of the string of ``window`` bytes at each position of equally long texts (rows of bytes): equal
    strings, and no others, have one.

    The first buckets are the 8-grams, by their bytes. They are refined by sorting positions on their bucket
    and on that of the position ``width`` bytes on, and what comes of it is the bucket that the next, twice as
    wide refinement sorts on, here and at later offsets alike; the last one overlaps."""
    wide, width = texts.shape[1], 8
    grams = np.zeros((len(texts), wide - 7), np.uint64)
    for k in range(8):
        grams = grams << np.uint64(8) | texts[:, k : wide - 7 + k]
    bucket = _numbered(grams)
    while width < window:
        further = min(width, window - width)
        bucket = _numbered(bucket[:, :-further] << np.uint64(32) | bucket[:, further:])
        width += further
    return bucket


def _numbered(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones, which are fewer than 2 ** 32."""
    flat = keys.reshape(-1)
    order = np.argsort(flat)
    out = np.empty(len(flat), np.uint64)
    out[order] = (np.cumsum(_begins(flat[order])) - 1).astype(np.uint64)
    return out.reshape(keys.shape)


def _resolved_windows(window: int) -> Callable[[pa.Table], pa.Table]:
    kind = _runs_dtype(window)

    def run(t: pa.Table) -> pa.Table:
        rows, src = _unpack(t, kind)
        order = np.argsort(rows["r"], kind="stable")
        masks = np.zeros(len(rows), np.uint32)
        cuts = np.flatnonzero(np.r_[True, np.diff(rows["r"][order]) != 0])
        pieces, held = [], 0  # whole leaders, some ten thousand runs at a time
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
            if not held or lo - pieces[-1][0] > CHUNK_RUNS:
                pieces.append([lo, hi])
                held = 1
            pieces[-1][1] = hi
        for lo, hi in pieces if len(order) else []:
            part = order[lo:hi]
            r = rows[part]
            n = r["n"].astype(np.int64)
            own = np.repeat(np.arange(len(r)), n)
            step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            name = refined(r["t"], window)[own, step]
            leader = (np.cumsum(_begins(r["r"])) - 1).astype(np.uint64)[own]
            key = leader << np.uint64(32) | name
            by = np.argsort(key)
            o, new = own[by], _begins(key[by])
            d = r["d"][o]
            least = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
            gone = least < d
            bits = np.left_shift(np.uint32(1), step[by][gone].astype(np.uint32))
            got = np.zeros(len(r), np.uint32)
            np.bitwise_or.at(got, o[gone], bits)
            masks[part] = got
        out = np.empty(len(rows), _MASK)
        out["u"], out["m"] = rows["u"], masks
        return _back(0, src[masks > 0], out[masks > 0])

    return run


def _lookup(keys: np.ndarray, table: np.ndarray, value: str, default: int = 0) -> np.ndarray:
    """Values by name; where a name stands more than once, the values are joined by or."""
    out = np.full(len(keys), default, table[value].dtype)
    if len(table):
        order = np.argsort(table["u"], kind="stable")
        u = table["u"][order]
        start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        v = np.bitwise_or.reduceat(table[value][order], start)
        u = u[start]
        at = np.minimum(np.searchsorted(u, keys), len(u) - 1)
        out = np.where(u[at] == keys, v[at], out)
    return out


def remove_repeats(docs: DataFrame, ws: Workspace, window: int = 50, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row: the removed byte ranges and the bytes that stay.

    A byte goes if a string of ``window`` bytes that covers it also starts in a document with a smaller
    doc_id; strings are judged on the input and lie within one document. A null text is empty. Rows that
    repeat a doc_id are neither earlier than the other. A row with a null doc_id stays whole and is no
    earlier document to any. Texts shorter than the window stay. Other columns are ignored; an empty table
    gives an empty one.
    """
    if not GRAM < window <= 200:
        raise ValueError(f"windows of {GRAM + 1} to 200 bytes")
    data = docs.select("doc_id", F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data"))
    total = data.agg(F.sum(F.octet_length("data")).alias("n")).head()["n"] or 0
    batches = max(1, -(-total // BATCH_BYTES))
    shards = max(1, -(-total // SHARD_BYTES))
    known = data.filter("doc_id is not null").withColumn("b", F.expr(f"pmod(xxhash64(doc_id), {batches})"))
    none = pa.table({"to": pa.array([], pa.int64()), "src": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})

    def batch_of(key) -> int:
        return int(key[0].as_py())

    def send_leaders(key, t):
        a = np.sort(Batch(t, window, named=False).leader)
        a = a[_begins(a)]
        return _deal(batch_of(key), a, a, shards)

    def send_runs(key, t, met):
        if not t.num_rows:
            return none
        b = Batch(t, window)
        first, _ = b.firsts()
        first = first[b.leaders_met(_unpack(met, np.dtype("<u8"))[0])[first]]
        rows = np.empty(len(first), _RUN)
        rows["a"], rows["u"], rows["d"] = b.leader[first], b.name[first], b.doc[first]
        return _deal(batch_of(key), rows["a"], rows, shards)

    def send_windows(key, t, flags):
        if not t.num_rows or not flags.num_rows:
            return none
        b = Batch(t, window)
        first, _ = b.firsts()
        flag = _lookup(b.name[first], _unpack(flags, _FLAG)[0], "f")
        kind = _runs_dtype(window)
        wide = window + most_run(window) - 1
        padded = np.concatenate([b.data, np.zeros(wide, np.uint8)])
        some = first[flag == 2]
        rows = np.zeros(len(some), kind)
        rows["r"], rows["u"], rows["d"], rows["n"] = b.leader[some], b.name[some], b.doc[some], b.n[some]
        rows["t"] = padded[b.lo[some][:, None] + np.arange(wide)] if len(some) else rows["t"]
        rows["t"][np.arange(wide) >= (b.n[some] + window - 1)[:, None]] = 0
        parts = [rows]
        for run in first[flag == 4]:
            route, name = b.hot_windows(run)
            each = np.zeros(len(route), kind)
            each["r"], each["u"], each["d"], each["n"] = route, name, b.doc[run], 1
            each["t"][:, :window] = padded[b.lo[run] + np.arange(len(route))[:, None] + np.arange(window)]
            parts.append(each)
        rows = np.concatenate(parts)
        return _deal(batch_of(key), rows["r"], rows, shards)

    def finish(key, t, found):
        kinds = np.array(found.column("kind").to_pylist()) if found.num_rows else np.empty(0)
        b = Batch(t, window) if t.num_rows else None
        if b is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], _SPANS), "kept": pa.array([], pa.binary())})
        flags = _unpack(found.filter(pa.array(kinds == 0)), _FLAG)[0] if found.num_rows else np.empty(0, _FLAG)
        masks = _unpack(found.filter(pa.array(kinds == 1)), _MASK)[0] if found.num_rows else np.empty(0, _MASK)
        first, place = b.firsts()
        flag = _lookup(b.name[first], flags, "f")
        later = b.doc > b.doc[first][place] if len(first) else np.empty(0, bool)
        whole = later | (flag[place] == 1)
        cover = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(cover, b.lo[whole], 1)
        np.add.at(cover, b.lo[whole] + b.n[whole] - 1 + window, -1)
        part = np.flatnonzero(~whole & (flag[place] == 2))
        bits = _lookup(b.name[part], masks, "m")
        for step in range(most_run(window)):
            at = b.lo[part[(bits >> np.uint32(step)) & np.uint32(1) == 1]] + step
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
        for run in np.flatnonzero(~whole & (flag[place] == 4)):
            gone = np.flatnonzero(_lookup(b.hot_windows(run)[1], masks, "m"))
            np.add.at(cover, b.lo[run] + gone, 1)
            np.add.at(cover, b.lo[run] + gone + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        spans, kept = [], []
        for start, n in zip(b.starts, b.lengths, strict=True):
            g = gone[start : start + n]
            edge = np.flatnonzero(np.diff(np.r_[0, g.astype(np.int8), 0]))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(b.data[start : start + n][~g].tobytes())
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_bytes": pa.array(b.lengths, pa.int64()), "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary())})

    def reduce(sent: DataFrame, by) -> DataFrame:
        return sent.groupBy("to").applyInArrow(by, _PACKED)

    grouped = known.groupBy("b")
    met = ws.save(reduce(grouped.applyInArrow(send_leaders, _PACKED), _shared_leaders), "met", release=True)
    flags = ws.save(reduce(grouped.cogroup(met.groupBy("to")).applyInArrow(send_runs, _PACKED), _resolved_runs), "flags", release=True)
    ws.drop(met)
    masks = ws.save(reduce(grouped.cogroup(flags.groupBy("to")).applyInArrow(send_windows, _PACKED), _resolved_windows(window)), "masks", release=True)
    found = flags.withColumn("kind", F.lit(0)).unionByName(masks.withColumn("kind", F.lit(1)))
    out = grouped.cogroup(found.groupBy("to")).applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    whole = data.filter("doc_id is null").select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.col("data").alias("kept"))
    return out.unionByName(whole)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
