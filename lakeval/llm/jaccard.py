"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles as 64-bit hashes. Documents are banded by set size. In a band,
sets that may be linked differ in at most ``d`` shingles. Shingles are XOR-ed into a sketch: twice the same
cancels, so what differs between two sketches stands for shingles that only one set has. It is made in two
widths:

* for the join, more than ``d`` segments of 64 bits. The number of segments that differ is a lower bound of
  the symmetric difference, so two linked sets agree in at least one segment (pigeonhole). Segments are
  joined within the band.
* for what meets, one bit a shingle in a sketch of some four times ``d`` bits. Its Hamming distance is a
  lower bound as well, and a pair beyond its own bound is dropped before any text moves.

What is left is verified on the real words. Segments that no shingle fell in say nothing and would join
unlike sets. Each sketch has ``spare`` more segments than the pigeonhole needs, as many as sets of the band's
least size leave empty; a set with at most so many empty ones surely agrees with a linked set in one that isn't
empty, and only the rare sets with more of them also offer their empty segments. Of the spare segments that
aren't empty a set needn't be joined by either (``slack``): it leaves out that many of its keys, those with the
most nodes. All sets order keys alike, so of the keys that two linked sets share the rarest stays for both.

Keys are made once, in the pass that describes the sets, and sent packed, eight bytes each, to the part that
looks for keys of two documents. A key that is common within a task is settled there and sent on once.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..workspace import Workspace, bound_batches

BAND = 1.5
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _hand_back() -> None:
    """Give what a task held back to the system, as the worker serves other stages next. A function of the module,
    since what is sent to a worker with a nested function gets copies of the module's values."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _K[0]
    h = (h ^ (h >> np.uint64(29))) * _K[1]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words of a text, A-Z lower-cased, cut at ASCII
    white space. A text with fewer words is one shingle; without words or with a null there is none."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mixed(out * _K[2] + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    """Whether ``q * intersection >= p * union`` for two sorted sets; empty ones are linked with nothing."""
    small, large = sorted((len(a), len(b)))
    if not small or q * small < p * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return q * both >= p * (small + large - both)


def _empty(balls: int, bins: int) -> float:
    """Segments that so many shingles leave empty, by three standard deviations more than the mean."""
    e = math.exp(-balls / bins)
    return bins * e + 3 * math.sqrt(max(0.0, bins * e * (1 - (1 + balls / bins) * e)))


class Sketches:
    """Join keys of a set for a threshold of ``p / q``."""

    def __init__(self, p: int, q: int, band: float = BAND):
        self.p, self.q, self.floors = p, q, [1]
        self._counts: dict[int, tuple[int, int]] = {}
        while self.floors[-1] < 1 << 40:
            self.floors.append(max(self.floors[-1] + 1, int(self.floors[-1] * band)))

    def _segments(self, band: int) -> tuple[int, int]:
        """Segments and spare ones: linked sets, the smaller of the band, differ in at most
        ``a * (q - p) / p`` shingles for the band's largest size ``a``. Spare are 4 and one of 64, or as many as
        hold the segments that the band's least size leaves empty, by three standard deviations; where its
        shingles are too few for that at any number, the former."""
        if band not in self._counts:
            d = (self.floors[band + 1] - 1) * (self.q - self.p) // self.p
            n = d + 1
            spare = least = 0 if n == 1 else 4 + n // 64
            if n > 1:
                while spare <= 2 * n and _empty(self.floors[band], n + spare) > spare:
                    spare += 1 + spare // 32
                spare = least if spare > 2 * n else spare
            self._counts[band] = n + spare, spare
        return self._counts[band]

    def keys(self, found: np.ndarray, seed: int = 0) -> np.ndarray:
        return self.keys_and_slack(found, seed)[0]

    def keys_and_slack(self, found: np.ndarray, seed: int = 0) -> tuple[np.ndarray, list[int]]:
        """Keys, the lowest bit being that of their band, and how many of them with that bit 0, and 1, the set can
        do without: a linked set shares more."""
        n, slack = len(found), [0, 0]
        if not n:
            return np.empty(0, np.uint64), slack
        at = int(np.searchsorted(self.floors, n, side="right")) - 1
        bands = [at]
        if at and n * self.p <= (self.floors[at] - 1) * self.q:  # a smaller partner may be in the band below
            bands.append(at - 1)
        out = []
        with np.errstate(over="ignore"):
            token = _mixed(found + np.uint64(seed + 1) * _K[3])
            for band in bands:
                count, spare = self._segments(band)
                where = (token >> np.uint64(33)) % np.uint64(count)
                order = np.argsort(where, kind="stable")
                used, start = np.unique(where[order], return_index=True)
                value = np.bitwise_xor.reduceat(_mixed(token[order] + _K[2]), start)
                base = np.uint64((band * 64 + seed) % 2**64) * _K[1]
                made = [_mixed(_mixed(value + base) + used * _K[0])]
                slack[band & 1] = max(0, spare - (count - len(used)))
                if count - len(used) > spare:
                    empty = np.setdiff1d(np.arange(count, dtype=np.uint64), used)
                    made.append(_mixed(_mixed(np.zeros(len(empty), np.uint64) + base) + empty * _K[0]))
                out.extend(k & ~np.uint64(1) | np.uint64(band & 1) for k in made)
        return np.unique(np.concatenate(out)), slack


def exactly_linked(ta: str | None, tb: str | None, words: int, p: int, q: int) -> bool:
    """Whether two texts are linked, by their words and not by hashes: words, then runs of them, are numbered
    within the pair."""
    number: dict[bytes, int] = {}
    found = [np.array([number.setdefault(w, len(number)) for w in (t or "").encode("utf-8", "surrogatepass").lower().split()], np.int64) for t in (ta, tb)]
    if not all(map(len, found)):
        return False
    short = [len(f) < words for f in found]
    if any(short):
        return all(short) and np.array_equal(*found)
    code = found
    for k in range(1, words):
        both = np.concatenate([c[: len(f) - k] * len(number) + f[k:] for c, f in zip(code, found, strict=True)])
        rank = np.unique(both, return_inverse=True)[1]
        code = [rank[: len(found[0]) - k], rank[len(found[0]) - k :]]
    a, b = (np.unique(c) for c in code)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return q * both >= p * (len(a) + len(b) - both)


def parity_bits(found: np.ndarray, p: int, q: int) -> np.ndarray:
    """The bit sketch of a set as 64-bit words: a power of two, 256 bits at least, four times the shingles
    that it may differ in."""
    bits = 256
    while bits < 4 * (len(found) * (q - p) // p):
        bits *= 2
    on = np.bincount((_mixed(found) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little").view(np.int64)


#: Keys that a task holds before it sends them, key bytes that one part gets, and how often a key stands in
#: what a task holds for it to be settled there. None of them changes a result.
FLUSH_KEYS = 1 << 21
PART_BYTES = 8 << 20
COMMON = 64

_MADE = "doc_id long, n_shingles long, digest binary, sketch array<long>, slack array<long>, part long, data binary"
_PAIR = np.dtype([("key", "<i8"), ("node", "<i8")])


def _sent(keys: np.ndarray, nodes: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """(part, packed keys) of a task's keys; part -1 has the rows of common keys as (key, node)."""
    part = (keys >> np.uint64(44)) % np.uint64(parts)
    name = part << np.uint64(40) | keys & np.uint64((1 << 40) - 1)
    order = np.lexsort((nodes, name))
    name, nodes = name[order], nodes[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (nodes[1:] != nodes[:-1])
    name, nodes = name[new], nodes[new]
    start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.empty(0, np.int64)
    count = np.diff(np.r_[start, len(name)])
    common = np.repeat(count >= COMMON, count)
    out = []
    if common.any():
        rows = np.empty(int(common.sum()), _PAIR)
        rows["key"], rows["node"] = name[common].view(np.int64), nodes[common]
        out.append((-1, rows.tobytes()))
    first = np.zeros(len(name), bool)
    first[start] = True
    keep = ~common | first
    name, nodes = name[keep], nodes[keep]
    part = (name >> np.uint64(40)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for low, high in zip(cuts, np.r_[cuts[1:], len(part)] if len(part) else [], strict=True):
        known, at = np.unique(nodes[low:high], return_inverse=True)
        entries = (name[low:high] & np.uint64((1 << 40) - 1)) << np.uint64(24) | at.astype(np.uint64)
        out.append((int(part[low]), np.int64(len(known)).tobytes() + known.tobytes() + entries.tobytes()))
    return out


def describe(docs: DataFrame, words: int, p: int, q: int, parts: int, seed: int = 0) -> DataFrame:
    """Two kinds of rows from one pass over the texts: sets (doc_id, n_shingles, digest, sketch, slack; the
    digest is 128 bits of the whole set, null for an empty one), and packed keys (part, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Sketches(p, q)
        keys, nodes, met, held = [], [], {}, 0
        names = ["doc_id", "n_shingles", "digest", "sketch", "slack", "part", "data"]

        def packed() -> pa.RecordBatch:
            rows = _sent(np.concatenate(keys), np.concatenate(nodes), parts) if keys else []
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.list_(pa.int64())), pa.nulls(len(rows), pa.list_(pa.int64())), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=names)

        for b in batches:
            sizes, digests, sketches, slacks = [], [], [], []
            for t, node in zip(b.column("text"), b.column("doc_id").to_pylist(), strict=True):
                s = shingles(t.as_py(), words)
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                sizes.append(len(s))
                digests.append(digest)
                sketches.append(parity_bits(s, p, q) if len(s) else None)
                if digest is None or node is None or digest in met:
                    slacks.append(None if digest is None or node is None else met[digest])
                    continue
                k, slack = made.keys_and_slack(s, seed)
                slacks.append(slack)
                met[digest] = slack
                keys.append(k)
                nodes.append(np.full(len(k), node, np.int64))
                held += len(k)
                if held >= FLUSH_KEYS:
                    yield packed()
                    keys.clear()
                    nodes.clear()
                    met.clear()
                    held = 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(slacks, pa.list_(pa.int64())), none, pa.nulls(len(sizes), pa.binary())], names=names)
        yield packed()
        keys.clear()
        nodes.clear()
        met.clear()
        _hand_back()

    return docs.select("doc_id", "text").mapInArrow(run, _MADE)


def _met(t: pa.Table) -> pa.Table:
    """(key, node) of the keys of one part that two nodes have."""
    keys, nodes = [], []
    part = t.column("part")[0].as_py() if t.num_rows else 0
    for d in t.column("data"):
        raw = d.as_py()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        known, entries = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint64, -1, 8 + 8 * n)
        keys.append(entries >> np.uint64(24))
        nodes.append(known[(entries & np.uint64((1 << 24) - 1)).astype(np.int64)])
    key, node = np.concatenate(keys), np.concatenate(nodes)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    same = key[1:] == key[:-1]
    several = np.r_[False, same] | np.r_[same, False]
    del keys, nodes, order, new, same
    _hand_back()
    return pa.table({"key": pa.array((np.uint64(part) << np.uint64(40) | key[several]).view(np.int64)), "node": pa.array(node[several])})


def _common(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.column("data"):
                r = np.frombuffer(d.as_py(), _PAIR)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r["key"])), pa.array(np.ascontiguousarray(r["node"]))], names=["key", "node"])

    return rows.select("data").mapInArrow(run, "key long, node long")


def _near(a: str, b: str, p: int, q: int) -> Column:
    """Whether two sets (columns n_shingles, sketch of the aliases) may be linked by their sizes and by the
    Hamming distance of their sketches. A sketch twice as wide is folded to the other's width."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    s, t = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")

    def folded(c: Column) -> Column:
        half = (F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    s2 = F.when(F.size(s) > F.size(t), folded(s)).otherwise(s)
    t2 = F.when(F.size(t) > F.size(s), folded(t)).otherwise(t)
    distance = F.aggregate(F.zip_with(s2, t2, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, v: n + v)
    most = F.call_function("div", (x + y) * (q - p), F.lit(q + p))
    return (F.least(x, y) * q >= F.greatest(x, y) * p) & (distance <= most)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, p: int, q: int) -> DataFrame:
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([exactly_linked(x.as_py(), y.as_py(), words, p, q) for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(ok)
        _hand_back()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _needed(met: DataFrame, known: DataFrame, ws: Workspace) -> DataFrame:
    """Rows of ``met`` (key, node, component) less the keys that a node can do without: as many as its slack, those
    with the most nodes, and then the greatest, first. A node of several sets has the least of their slacks; what
    stays of its keys stays for each of them. A window has the keys of one node."""
    met = ws.save(met, "mixed", release=True)
    nodes = met.groupBy("key").agg(F.count("*").alias("nodes"))
    slack = known.groupBy("node").agg(F.min(F.col("slack")[0]).alias("even"), F.min(F.col("slack")[1]).alias("odd"))
    odd = F.col("key").bitwiseAND(1)
    rank = F.row_number().over(Window.partitionBy("node", odd).orderBy(F.desc("nodes"), F.desc("key")))
    ranked = met.join(nodes, "key").join(slack, "node").withColumn("rank", rank)
    return ranked.filter(F.col("rank") > F.when(odd == 1, F.col("odd")).otherwise(F.col("even"))).select("key", "node", "component")


def _groups(members: DataFrame, sets: DataFrame, docs: DataFrame, ws: Workspace, words: int, p: int, q: int) -> DataFrame:
    """(node, component) of the nodes that are linked to another, from distinct (key, node) of shared keys.

    Each node is first verified against the least node of the key fellows that it meets most often, then
    against the least nodes of its other keys that it isn't grouped with yet. Keys whose nodes are all of one
    group by then are settled. Under the others, less those that a node can do without, nodes are joined across groups,
    and the join lets through only pairs whose sizes and sketches allow a link."""
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = ws.save(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "texts", release=True)
    known = ws.save(sets.join(wanted.withColumnRenamed("doc_id", "node").hint("merge"), "node", "left_semi"), "known", release=True)
    lead = members.groupBy("key").agg(F.min("node").alias("lead"))
    leads = members.join(lead, "key").filter("node != lead").groupBy("lead", "node").agg(F.count("*").alias("n"))
    best = leads.groupBy("node").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead"))
    stars = ws.save(best.select(F.col("lead").alias("a"), F.col("node").alias("b")), "stars", release=True)
    x, y = known.alias("x"), known.alias("y")
    near = stars.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(_near("x", "y", p, q)).select("a", "b").distinct()
    links = ws.save(_verified(near, texts, words, p, q), "links")
    groups = ws.save(connected_components(links, ws), "groups")
    of = groups.select(F.col("node").alias("n"), "component")
    every = leads.select("lead", "node").join(of, F.col("node") == F.col("n"), "left").select("lead", "node", F.coalesce("component", "node").alias("cn"))
    every = every.join(of, F.col("lead") == F.col("n"), "left").filter(F.col("cn") != F.coalesce("component", "lead")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    rest = ws.save(every.join(stars, ["a", "b"], "left_anti"), "rest", release=True)
    near = rest.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(_near("x", "y", p, q)).select("a", "b").distinct()
    found = ws.save(_verified(near, texts, words, p, q), "links")
    if not found.isEmpty():
        links = links.unionAll(found)
        groups = ws.save(connected_components(links, ws), "groups")
    stars = stars.unionAll(rest)
    grouped = members.join(groups.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    left = _needed(grouped.join(mixed, "key"), known, ws)
    left = ws.save(left.join(known.select("node", "n_shingles", "sketch"), "node"), "left", release=True)
    if left.isEmpty():
        return groups
    x, y = left.alias("x"), left.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _near("x", "y", p, q))
    pairs = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    pairs = ws.save(pairs.join(stars, ["a", "b"], "left_anti"), "pairs", release=True)
    found = ws.save(_verified(pairs, texts, words, p, q), "links")
    if found.isEmpty():
        return groups
    return ws.save(connected_components(links.unionAll(found), ws), "groups")


def join(docs: DataFrame, ws: Workspace, words: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; others are ignored).

    Two rows are linked when ``q * intersection >= p * union`` of their shingle sets; the component is the
    smallest doc_id that links reach. Rows with equal sets are one node of the join, so copies are never
    paired. A row without words, or with a null text, is linked with nothing. Rows that repeat a doc_id are
    one document, linked to what any of their texts is linked to. A null doc_id is linked with nothing and
    its component is null. An empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    ws = ws.child("jaccard")
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    made = ws.save(describe(docs, words, p, q, max(1, -(-total // PART_BYTES))), "made", release=True)
    sets = ws.save(made.filter("part is null").select("doc_id", "n_shingles", "digest", "sketch", "slack"), "sets", release=True)
    met = made.filter("part >= 0").select("part", "data").groupBy("part").applyInArrow(_met, "key long, node long")
    met = ws.save(met.unionAll(_common(made.filter("part = -1"))), "met", release=True)
    ws.drop(made)
    named = sets.filter("digest is not null and doc_id is not null")
    classes = ws.save(named.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    nodes = named.join(classes, "digest").select("doc_id", "node", "n_shingles", "sketch", "slack")
    members = ws.save(met.join(nodes.select("doc_id", F.col("node").alias("of")).distinct(), met["node"] == nodes["doc_id"]).select("key", F.col("of").alias("node")).distinct(), "members", release=True)
    ws.drop(met)
    mixed = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("key")
    members = ws.save(members.join(mixed, "key").select("key", "node"), "members", release=True)
    groups = _groups(members, nodes.filter("doc_id = node").select("node", "n_shingles", "sketch", "slack"), docs, ws, words, p, q)
    labels = classes.join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = sets.join(labels, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    out = ws.save(out, "out", release=True)
    ws.keep(out)
    return out
