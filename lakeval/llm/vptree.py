"""Nearest neighbours by cosine with a vantage-point tree in each shard of the rows.

Vectors of length one under Euclidean distance are a metric space with the same order as cosine. A node
of a tree keeps a vantage point and, for the near and the far half of the rest, the least and largest
distance to it; by the triangle inequality a query at distance ``d`` from the point can find nothing in a
half that is nearer than ``max(least - d, d - largest)``. A half is left out when ``factor`` times that
bound exceeds the distance of the k-th best so far. Factor one leaves out nothing that counts, so search
is exact; a larger factor leaves out more and may miss neighbours.

The top of the tree deals rows to cells, so that by the same bound a query goes only to the cells that it
reaches; below, each shard of a cell has a tree of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

SHARD_ROWS = 25_000
LEAF_ROWS = 192
#: Scores this close are compared again by one fixed order of additions.
SLACK = 1e-9


class Tree:
    """A vantage-point tree over the rows of one shard (double precision)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = _norms(vectors)
        self.units = vectors / self.norms[:, None]
        self.root = self._build(np.arange(len(ids)), np.random.default_rng(len(ids)))

    def _build(self, rows: np.ndarray, rng: np.random.Generator) -> dict:
        if len(rows) <= LEAF_ROWS:
            return {"rows": rows}
        tried = rng.choice(rows, 8, replace=False)
        probe = rng.choice(rows, min(len(rows), 128), replace=False)
        spread = _chord(self.units[tried] @ self.units[probe].T).var(axis=1)
        point = self.units[tried[int(spread.argmax())]]
        d = _chord(self.units[rows] @ point)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return {"point": point, "near": (d[near].min(), d[near].max(), self._build(rows[near], rng)), "far": (d[far].min(), d[far].max(), self._build(rows[far], rng))}

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, cosine) of the k best of each query, a row of the query's own id left out."""
        best = _Best(len(qids), k)
        qn = _norms(queries)
        units = queries / qn[:, None]
        everyone = np.arange(len(qids))

        def leaf(rows: np.ndarray, active: np.ndarray) -> None:
            rough = units[active] @ self.units[rows].T
            a, b = np.nonzero(rough >= best.worst[active][:, None] - SLACK)
            a, b = active[a], rows[b]
            other = self.ids[b] != qids[a]
            a, b = a[other], b[other]
            score = np.einsum("ij,ij->i", queries[a], self.vectors[b]) / (qn[a] * self.norms[b])
            best.add(a, self.ids[b], score)

        def first(node: dict, active: np.ndarray) -> None:
            """Down the half that each query lies in, for a first bound."""
            while len(active) and "rows" not in node:
                inside = _chord(units[active] @ node["point"]) <= node["near"][1]
                first(node["near"][2], active[inside])
                node, active = node["far"][2], active[~inside]
            if len(active):
                leaf(node["rows"], active)

        def rest(node: dict, active: np.ndarray) -> None:
            if not len(active):
                return
            if "rows" in node:
                return leaf(node["rows"], active)
            d = _chord(units[active] @ node["point"])
            for side in ("near", "far"):
                low, high, child = node[side]
                reach = _chord(best.worst[active])
                bound = np.maximum(low - d, d - high)
                rest(child, active[bound * factor <= reach + 1e-7])

        first(self.root, everyone)
        rest(self.root, everyone)
        return best.query, best.ids, best.score


class _Best:
    """The k best ids of each query: largest score, then smallest id; an id counts once."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.ids, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.worst = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.zeros(self.n, bool)
        touched[query] = True
        old = touched[self.query]
        q, i, s = (np.concatenate([x[old], y]) for x, y in ((self.query, query), (self.ids, ids), (self.score, score)))
        order = np.lexsort((-s, i, q))
        q, i, s = q[order], i[order], s[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
        q, i, s = q[new], i[new], s[new]
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = rank < self.k
        full = rank == self.k - 1
        self.worst[q[full]] = s[full]
        self.query = np.concatenate([self.query[~old], q[keep]])
        self.ids = np.concatenate([self.ids[~old], i[keep]])
        self.score = np.concatenate([self.score[~old], s[keep]])


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(cosine, -1e18)))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, np.ndarray, np.ndarray]]:
    """Runs of rows of one shard and kind, from batches sorted by (dim, shard, kind)."""
    for b in batches:
        dim, shard, kind = (b.column(c).to_numpy() for c in ("dim", "shard", "kind"))
        ids = b.column("vec_id").to_numpy()
        change = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip(np.r_[0, change], np.r_[change, len(ids)], strict=True):
            if hi > lo:
                flat = b.column("vector").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
                yield (int(dim[lo]), int(shard[lo])), int(kind[lo]), ids[lo:hi], flat.reshape(hi - lo, -1).astype(np.float64)


class Cells:
    """The top of the tree, over a sample of the rows of one dimension: each leaf is a cell of the space.

    A cell knows the vantage points above it. With the least and greatest distance of its rows to each of
    them, the triangle inequality bounds how near anything in the cell can be to a query."""

    def __init__(self, vectors: np.ndarray, wanted: int):
        units = vectors / _norms(vectors)[:, None]
        rng = np.random.default_rng(len(vectors))
        self.points: list[np.ndarray] = []
        self.radius: list[float] = []
        self.paths: list[list[tuple[int, bool]]] = []
        todo = [(np.arange(len(units)), wanted, [])]
        while todo:
            rows, n, path = todo.pop()
            if n <= 1 or len(rows) < 16:
                self.paths.append(path)
                continue
            tried = rng.choice(rows, 8, replace=False)
            spread = _chord(units[tried] @ units[rows[:512]].T).var(axis=1)
            d = _chord(units[rows] @ units[tried[int(spread.argmax())]])
            radius, at = float(np.quantile(d, (n // 2) / n)), len(self.points)
            self.points.append(units[tried[int(spread.argmax())]])
            self.radius.append(radius)
            todo.append((rows[d > radius], n - n // 2, [*path, (at, False)]))
            todo.append((rows[d <= radius], n // 2, [*path, (at, True)]))
        self.depth = max(map(len, self.paths))
        self.above = np.full((len(self.paths), max(1, self.depth)), -1)
        for cell, path in enumerate(self.paths):
            self.above[cell, : len(path)] = [at for at, _ in path]

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        units = vectors / _norms(vectors)[:, None]
        return _chord(units @ np.array(self.points).T) if self.points else np.empty((len(vectors), 0))

    def place(self, d: np.ndarray) -> np.ndarray:
        """The cell of each row, from its distances to all vantage points."""
        out = np.zeros(len(d), np.int64)
        left = np.ones(len(d), bool)
        for cell, path in enumerate(self.paths):
            inside = left.copy()
            for at, near in path:
                inside &= (d[:, at] <= self.radius[at]) == near
            out[inside] = cell
            left &= ~inside
        return out

    def spans(self, d: np.ndarray, cell: np.ndarray) -> dict[int, np.ndarray]:
        """By cell, (least, greatest) distance of its rows to each vantage point above it."""
        out = {}
        for c in np.unique(cell):
            above = self.above[c][self.above[c] >= 0]
            own = d[cell == c][:, above]
            out[int(c)] = np.stack([own.min(axis=0), own.max(axis=0)]) if len(above) else np.zeros((2, 0))
        return out

    def reached(self, d: np.ndarray, reach: np.ndarray, spans: dict[int, np.ndarray], factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that may hold something within ``reach`` of a row."""
        rows, cells = [], []
        for c, (low, high) in spans.items():
            above = self.above[c][self.above[c] >= 0]
            own = d[:, above]
            bound = np.maximum(low - own, own - high).max(axis=1, initial=0.0)
            hit = np.flatnonzero(bound * factor <= reach + 1e-7)
            rows.append(hit)
            cells.append(np.full(len(hit), c))
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


#: Rows that the top of the tree is made from, and cells that it has at most; beyond that a cell is dealt to
#: several shards. What the driver and each task hold of it is bounded by these two.
SAMPLE_ROWS = 8192
MOST_CELLS = 4096


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _tops(rows: DataFrame, wanted: int) -> dict[int, Cells]:
    """The top of a tree for each dimension that the sample holds."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("dim", "vector").collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(r["dim"], []).append(r["vector"])
    return {dim: Cells(np.array(v, np.float64), wanted) for dim, v in by.items()}


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        dim = b.column("dim").to_numpy()
        for one in np.unique(dim):
            yield int(one), b.filter(pa.array(dim == one))


def _placed(rows: DataFrame, tops: dict[int, Cells]) -> DataFrame:
    """Add ``cell``; rows of a dimension that the sample lacks are in cell 0."""

    def run(batches):
        for dim, b in _by_dim(batches):
            top = tops.get(dim)
            cell = top.place(top.distances(_flat(b.column("vector")))) if top else np.zeros(b.num_rows, np.int64)
            yield b.append_column("cell", pa.array(cell))

    return rows.mapInArrow(run, "vec_id long, vector array<double>, dim int, cell long")


def _spans(placed: DataFrame, tops: dict[int, Cells]) -> dict[int, dict[int, np.ndarray]]:
    """(least, greatest) distances by dimension and cell. Tasks and then Spark sum them up first; the driver
    gets one row a cell and vantage point above it."""

    def run(batches):
        for dim, b in _by_dim(batches):
            top = tops.get(dim)
            if not top:
                continue
            found = top.spans(top.distances(_flat(b.column("vector"))), b.column("cell").to_numpy())
            rows = [(dim, c, k, low, high) for c, s in found.items() for k, (low, high) in enumerate(s.T.tolist() or [(0.0, 0.0)])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["dim", "cell", "k", "low", "high"])

    least = placed.mapInArrow(run, "dim int, cell long, k int, low double, high double").groupBy("dim", "cell", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, dict[int, list]] = {}
    for r in least.orderBy("dim", "cell", "k").collect():
        out.setdefault(r["dim"], {}).setdefault(r["cell"], []).append((r["low"], r["high"]))
    return {dim: {c: np.array(v).T if len(tops[dim].points) else np.zeros((2, 0)) for c, v in cells.items()} for dim, cells in out.items()}


def search(rows: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS, block: int = 2048) -> DataFrame:
    """The ``k`` nearest ids of each query id: query_id, rank, vec_id, score.

    ``rows`` and ``queries`` have vec_id and vector (array of numbers); other columns are ignored. Rows with
    a null id or vector, a zero vector, an empty one, or null, NaN or infinite components take no part. Only
    vectors of one length are compared. Rows that repeat an id count once, at their largest cosine; a
    query's own id is no candidate. Ties go to the smaller id. No rows or no queries give no result.

    Rows are dealt to the cells of a tree's top. A query is first searched in its own cell; how near its k-th
    best is there decides which other cells it is sent to. A shard has a tree of its own, and a task holds
    one shard and ``block`` queries at a time.
    """
    clean = "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x != 0)"
    typed = [F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")]
    rows, queries = (d.select(*typed).filter(clean).withColumn("dim", F.size("vector")) for d in (rows, queries))
    shards = max(1, -(-rows.count() // shard_rows))
    if shards == 1:
        at = F.lit(0).cast("long").alias("cell")
        return _best(_scan(rows.select("*", at), queries.select("*", at), 1, 1, k, factor, block), k)
    ws = Workspace(rows.sparkSession, "vptree")
    cells = min(shards, MOST_CELLS)
    parts = -(-shards // cells)
    tops = _tops(rows, cells)
    kept = ws.save(_placed(rows, tops), "rows")
    asked = ws.save(_placed(queries, tops), "queries")
    spans = _spans(kept, tops)
    first = ws.save(_scan(kept, asked, cells, parts, k, factor, block), "first")
    worst = _best(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("q_"), F.col("score").alias("worst"))

    def route(batches):
        for dim, b in _by_dim(batches):
            top = tops.get(dim)
            if not top:
                continue
            reach = _chord(np.nan_to_num(b.column("worst").to_numpy(zero_copy_only=False), nan=-np.inf, neginf=-np.inf))
            at, cell = top.reached(top.distances(_flat(b.column("vector"))), reach, spans.get(dim, {}), factor)
            other = b.column("cell").to_numpy()[at] != cell
            at, cell = at[other], cell[other]
            for low in range(0, len(at), 65_536):
                some = b.take(pa.array(at[low : low + 65_536])).select(["vec_id", "vector", "dim"])
                yield some.append_column("cell", pa.array(cell[low : low + 65_536]))

    sent = asked.join(worst, F.col("vec_id") == F.col("q_"), "left").select("vec_id", "vector", "dim", "cell", "worst")
    sent = sent.mapInArrow(route, "vec_id long, vector array<double>, dim int, cell long")
    return _best(first.unionByName(_scan(kept, sent, cells, parts, k, factor, block)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best of each query; ties go to the smaller id."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score")))
    top = once.groupBy("query_id").agg(F.slice(order, 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _scan(rows: DataFrame, asked: DataFrame, cells: int, parts: int, k: int, factor: float, block: int) -> DataFrame:
    """(query_id, vec_id, score) of the ``k`` best of each query in each shard of the cell that it is sent to."""
    kept = rows.withColumn("shard", F.col("cell") * parts + F.pmod(F.xxhash64("vec_id"), F.lit(parts))).withColumn("kind", F.lit(0))
    sent = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("shard", F.col("cell") * parts + F.col("part")).withColumn("kind", F.lit(1))
    cols = ["dim", "shard", "kind", "vec_id", "vector"]
    both = kept.select(cols).unionByName(sent.select(cols)).repartition(cells * parts, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def run(batches):
        at, tree, held, pending = None, None, [], []

        def answer(tree, pending):
            ids = np.concatenate([p[0] for p in pending])
            q, i, s = tree.search(ids, np.concatenate([p[1] for p in pending]), k, factor)
            return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

        for key, kind, ids, vectors in _shards(batches):
            if key != at:
                if tree and pending:
                    yield answer(tree, pending)
                at, tree, held, pending = key, None, [], []
            if kind == 0:
                held.append((ids, vectors))
                continue
            if held:
                tree = Tree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held = []
            if tree:
                pending.append((ids, vectors))
                if sum(len(p[0]) for p in pending) >= block:
                    yield answer(tree, pending)
                    pending = []
        if tree and pending:
            yield answer(tree, pending)

    return both.mapInArrow(run, "query_id long, vec_id long, score double")
