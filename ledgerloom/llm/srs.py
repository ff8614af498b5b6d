"""Nearest vectors by a few stable projections and kd-trees (SRS; Sun et al., 2014).

All vectors are projected on `DIMS` Gaussian directions. A coarse kd-tree on a bounded sample of the projections cuts
space into cells of about `BLOCK` rows (at most `CELLS` of them); a cell of more rows is split by a hash of the id into
blocks of bounded size. For a vector at distance d, squared projected distance over d^2 is chi-square with DIMS degrees
of freedom. So a true neighbour has, with probability `SURE`, a projected distance of at most d_k * sqrt(quantile), where
d_k is the distance of the k-th best so far: rows beyond are not verified. This is the stopping test.

A query first searches its own cell, which bounds d_k; then all other cells that the test doesn't rule out. In a
block a kd-tree over the projections yields leaves in the order of projected distance until the next one fails the
test; of their rows those that pass it are verified by their exact distance in double precision, the nearest
projections first. Blocks give their best k rows of a query; the best k of those remain. Queries are never broadcast.

How much is skipped depends on the data: the given embeddings are nearly isotropic in 64 dimensions (a tenth neighbour
is at 0.75 of the median distance), where any projection on 16 directions leaves about half of the rows to verify.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
different lengths are not compared, each length is searched on its own; fewer than k candidates give all of them; ties
go to the smaller vec_id; rows of equal vec_id are one query (the least of their vectors) and aren't its neighbours, but
are each a candidate of others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drawn, prepare
from .vectors import group_starts, rows_of, runs, usable

K, DIMS, CELLS, SAMPLE, BLOCK, LEAF, SEED = 10, 16, 4_096, 20_000, 8_000, 256, 5
#: Rows whose projected distances are looked at together, and rows verified before there is a bound.
AT_ONCE, FIRST = 1_024, 64
#: Probability with which a true neighbour passes the stopping test.
SURE = 0.95


def chi2_quantile(p: float, dims: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom, by bisection."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree in arrays: split axis and value of inner nodes, boxes of all nodes, rows of the leaves."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.axis, self.value, self.kids, self.rows, self.low, self.high = [], [], [], [], [], []
        stack = [(np.arange(len(points)), -1, 0)]
        while stack:
            at, parent, side = stack.pop()
            node = len(self.axis)
            if parent >= 0:
                self.kids[parent][side] = node
            p = points[at]
            low, high = (p.min(axis=0), p.max(axis=0)) if len(at) else (np.zeros(points.shape[1]),) * 2
            axis = int(np.argmax(high - low))
            cutting = len(at) > leaf and high[axis] > low[axis]
            self.low.append(low)
            self.high.append(high)
            self.axis.append(axis if cutting else -1)
            self.kids.append([-1, -1])
            if not cutting:
                self.value.append(0.0)
                self.rows.append(at)
                continue
            mid = float(np.median(p[:, axis]))
            left = p[:, axis] < mid if mid > low[axis] else p[:, axis] <= mid
            self.value.append(mid if mid > low[axis] else float(np.nextafter(mid, np.inf)))
            self.rows.append(None)
            stack += [(at[~left], node, 1), (at[left], node, 0)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf in whose part of space each point lies."""
        node, axis, value, kids = np.zeros(len(points), np.int64), np.array(self.axis), np.array(self.value), np.array(self.kids)
        while (inner := np.flatnonzero(axis[node] >= 0)).size:
            n = node[inner]
            node[inner] = kids[n, (points[inner, axis[n]] >= value[n]).astype(np.int64)]
        return node

    def regions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves and the (open) boxes of space that belong to them."""
        dims = self.low.shape[1]
        out, stack = [], [(0, np.full(dims, -np.inf), np.full(dims, np.inf))]
        while stack:
            node, low, high = stack.pop()
            if self.axis[node] < 0:
                out.append((node, low, high))
                continue
            a, v = self.axis[node], self.value[node]
            for side, kid in enumerate(self.kids[node]):
                lo, hi = low.copy(), high.copy()
                (lo if side else hi)[a] = v
                stack.append((kid, lo, hi))
        return np.array([n for n, _, _ in out]), np.array([x for _, x, _ in out]), np.array([x for _, _, x in out])

    def nearest_leaves(self, q: np.ndarray):
        """(squared distance to the box, rows) of leaves, nearest first."""
        gap2 = lambda nodes: (np.maximum(np.maximum(self.low[nodes] - q, q - self.high[nodes]), 0) ** 2).sum(axis=-1)
        heap = [(float(gap2(0)), 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if self.axis[node] < 0:
                yield d, self.rows[node]
            else:
                for kid, g in zip(self.kids[node], gap2(self.kids[node]).tolist(), strict=True):
                    heapq.heappush(heap, (g, kid))


class Index:
    """Projections and the coarse cells."""

    def __init__(self, sample: np.ndarray, cells: int, dims: int = DIMS):
        self.width = sample.shape[1]
        self.directions = np.random.default_rng(SEED).standard_normal((self.width, dims))
        self.tree = Tree(self.project(sample), max(1, 2 * -(-len(sample) // cells)))
        self.cells, self.low, self.high = self.tree.regions()

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions

    def cell_gaps2(self, q: np.ndarray) -> np.ndarray:
        """Squared distances from projected queries to every cell."""
        return (np.maximum(np.maximum(self.low[None] - q[:, None], q[:, None] - self.high[None]), 0) ** 2).sum(axis=2)


def _located(index: Index):
    def run(incoming):
        for b in incoming:
            yield b.append_column("cell", pa.array(index.tree.leaf_of(index.project(rows_of(b.column(1), index.width))).astype(np.int64)))

    return run


def _spread(index: Index, quantile: float):
    """For queries (vec_id, embedding, cell, d_k): one row for each other cell that the stopping test leaves."""

    def run(incoming):
        for b in incoming:
            near = index.cell_gaps2(index.project(rows_of(b.column(1), index.width)))
            d = b.column(3).to_numpy(zero_copy_only=False)
            ok = near <= (np.where(np.isnan(d), np.inf, d) ** 2 * quantile * (1 + 1e-9) + 1e-12)[:, None]
            ok &= index.cells[None] != b.column(2).to_numpy()[:, None]
            q, c = np.nonzero(ok)
            yield b.take(pa.array(q)).set_column(2, "cell", pa.array(index.cells[c]))

    return run


def search(tree: Tree, points: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, pq: np.ndarray, own: int, k: int, quantile: float, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The best k rows of a block for one query: ids, exact squared distances, and how many rows were verified; `bound` is
    a distance known to hold k."""
    best_d, best_id = np.zeros(0), np.zeros(0, np.int64)
    limit, verified = bound * bound * (1 + 1e-12), 0
    todo: list[np.ndarray] = []
    waiting = 0

    def verify(rows: np.ndarray) -> None:
        nonlocal best_d, best_id, limit, verified
        d = ((x[rows] - q) ** 2).sum(axis=1)
        verified += len(rows)
        best_d, best_id = np.concatenate([best_d, d]), np.concatenate([best_id, ids[rows]])
        order = np.lexsort((best_id, best_d))[:k]
        best_d, best_id = best_d[order], best_id[order]
        if len(best_d) == k:
            limit = min(limit, best_d[-1])

    def look() -> None:
        """Verify those of the waiting rows that pass the test, the nearest projections first."""
        rows = np.concatenate(todo)
        todo.clear()
        rows = rows[ids[rows] != own]
        near = ((points[rows] - pq) ** 2).sum(axis=1)
        if len(rows) > FIRST:
            first = np.argpartition(near, FIRST)[:FIRST]
            verify(rows[first[near[first] <= limit * quantile * (1 + 1e-9) + 1e-12]])
            near[first] = np.inf
        verify(rows[near <= min(limit * quantile * (1 + 1e-9) + 1e-12, np.finfo(float).max)])

    for gap2, rows in tree.nearest_leaves(pq):
        if gap2 > limit * quantile * (1 + 1e-9) + 1e-12:
            break
        todo.append(rows)
        waiting += len(rows)
        if waiting >= AT_ONCE:
            look()
            waiting = 0
    if todo:
        look()
    return best_id, best_d, verified


def _searched(index: Index, k: int, quantile: float):
    """Rows (cell, block, is_query, vec_id, embedding, d_k), sorted with the vectors of a block before its queries."""

    def run(incoming):

        for t in runs(incoming, 2):
            starts = group_starts(t, 2).tolist()
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                part = t.slice(lo, hi - lo)
                asks, ids = part.column(2).to_numpy(), part.column(3).to_numpy()
                x, d = rows_of(part.column(4), index.width), part.column(5).to_numpy()
                n = int((~asks).sum())
                if n == 0 or n == len(ids):
                    continue
                points = index.project(x)
                tree = Tree(points[:n], LEAF)
                out = [search(tree, points[:n], x[:n], ids[:n], x[i], points[i], ids[i], k, quantile, d[i] if np.isfinite(d[i]) else np.inf) for i in range(n, len(ids))]
                size = np.array([len(a) for a, _, _ in out])
                ends = np.cumsum(size) - size
                verified = np.zeros(size.sum(), np.int64)  # on the first row of each query
                verified[ends[size > 0]] = np.array([v for _, _, v in out])[size > 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[n:], size)), pa.array(np.concatenate([a for a, _, _ in out])), pa.array(np.concatenate([b for _, b, _ in out])), pa.array(verified)], ["query_id", "vec_id", "d2", "verified"])

    return run


def nearest(rows: DataFrame, *, every: int = 100, k: int = K, sure: float = SURE, sample: int = SAMPLE, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance), verified (rows verified for the query) for queries whose vec_id
    is divisible by `every`."""
    spark = prepare(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    for width, n in sorted(rows.groupBy(F.size("embedding").alias("width")).count().collect()):
        out = out.union(_nearest(rows.where(F.size("embedding") == width), width, n, every, k, chi2_quantile(sure, DIMS), sample, block, min(cells, -(-n // block))))
    return out


def _nearest(rows: DataFrame, width: int, total: int, every: int, k: int, quantile: float, sample: int, block: int, cells: int) -> DataFrame:
    """`nearest` for vectors of one length."""
    taken = drawn(rows, ["vec_id"], sample, SEED, total).select("embedding").toArrow()
    index = Index(rows_of(taken["embedding"], width), cells)
    placed = cut(rows.mapInArrow(_located(index), "vec_id long, embedding array<double>, cell long"))
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    order = ["cell", "block", "is_query", "vec_id", "embedding", "d"]
    vectors = placed.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("is_query"), "vec_id", "embedding", F.lit(None).cast("double").alias("d"))
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("embedding", "cell")).alias("q")).select("vec_id", "q.embedding", "q.cell")

    def searched(queries: DataFrame) -> DataFrame:
        """`queries` (vec_id, embedding, cell, d) meet every block of their cell."""
        sent = queries.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_query"), "vec_id", "embedding", "d")
        both = vectors.union(sent).repartition("cell", "block").sortWithinPartitions("cell", "block", "is_query", "vec_id")
        return both.select(*order).mapInArrow(_searched(index, k, quantile), "query_id long, vec_id long, d2 double, verified long")

    home = cut(searched(asked.select("vec_id", "embedding", "cell", F.lit(None).cast("double").alias("d"))))
    ranked = W.partitionBy("query_id").orderBy("d2", "vec_id")
    kth = home.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    bound = kth.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.sqrt("d2").alias("d"))
    ready = asked.join(bound, "vec_id", "left").select("vec_id", "embedding", "cell", "d")
    found = cut(home.union(searched(ready.mapInArrow(_spread(index, quantile), "vec_id long, embedding array<double>, cell long, d double"))))
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    work = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    return best.drop("verified").join(work, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d2").alias("score"), "verified")
