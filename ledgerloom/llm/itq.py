"""Near-duplicate embeddings by iterative quantisation (Gong and Lazebnik, 2011) and multi-index Hamming tables.

Fit, on a bounded sample: centre, principal axes, then rotations that alternate between signs and the orthogonal
Procrustes solution, so that the bits are balanced and lose little. Each rotation gives a code of `width` bits; its
consecutive substrings of k bits are the keys of one hash table each. There are as many rotations as a pair at the
threshold needs to share a key with probability `recall` (see `ItqTables`: computed from the angles that are left once the
mean is gone, and measured); k grows with the logarithm of the rows of a label, so buckets keep their size, and shrinks
where a common mean makes codes of near vectors differ. Vectors that share a key and label, and whose whole codes are close
enough, are compared by cosine in double precision on the original vectors. A pair counts in the first table in which it meets.

Equal vectors of a label are grouped first; one stands for them. Buckets are cut into blocks of bounded size, and a
block gives counts and a spanning forest of its links, never its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link
with nothing; vectors of different lengths don't link; every row is a vector of its own, repeated rows link with each
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drawn, join_hot, prepare
from .components import components
from .vectors import blocked, forest, group_starts, pairs_in, rows_of, runs, usable

#: Rows of the fit (most), rows of a block, and the share of pairs at the threshold that a table set must find.
SAMPLE, BLOCK, RECALL = 20_000, 2_000, 0.998
THRESHOLD, SEED, ROUNDS = 0.93, 11, 30
#: Pairs made at the threshold to measure the recall of the tables, and tables at most that `plan` looks at for each k.
PROBES, MOST = 4000, 1 << 12


def partners(x: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector one at exactly `threshold`: for even rows moved at random, for odd ones along a line of the data."""
    u = rng.standard_normal(x.shape)
    u[1::2] = x[rng.permutation(len(x))[: len(u[1::2])]] - x[1::2]
    u -= np.einsum("ij,ij->i", u, x)[:, None] * x
    size = np.linalg.norm(u, axis=1, keepdims=True)
    spare = rng.standard_normal(x.shape)
    spare -= np.einsum("ij,ij->i", spare, x)[:, None] * x
    u = np.where(size > 1e-9, u / np.maximum(size, 1e-9), spare / np.maximum(np.linalg.norm(spare, axis=1, keepdims=True), 1e-9))
    return threshold * x + math.sqrt(1 - threshold * threshold) * u


class ItqTables:
    """Rotations and table keys for vectors of one length.

    Two unit vectors at the threshold are sqrt(2 - 2 * threshold) apart; what angle that is after the mean has been taken off
    depends on how far from the mean they lie. So the share of bits that differ is computed from the distances of the sample
    to its mean, k and the number of tables from that (the cheapest of all pairs of both that reach `recall`), and then tables
    are added until pairs made at the threshold (`partners`) are found as often as that.
    """

    def __init__(self, sample: np.ndarray, per_label: int, threshold: float = THRESHOLD, recall: float = RECALL):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = x.mean(axis=0)
        self.width = min(64, x.shape[1])
        self.axes = np.linalg.eigh((x - self.mean).T @ (x - self.mean))[1][:, ::-1][:, : self.width]
        rng, v = np.random.default_rng(SEED), (x - self.mean) @ self.axes
        far2 = np.maximum(np.einsum("ij,ij->i", v, v), 1e-12)
        flip = np.arccos(np.clip(1 - (1 - threshold) / far2, -1, 1)) / math.pi
        self.k, need = self.plan(flip, per_label, recall)
        self.rotations, self.tables = [], []
        self._data, self._rng = v, rng
        probe = x[rng.permutation(len(x))[:PROBES]] if len(x) > PROBES else np.tile(x, (-(-PROBES // len(x)), 1))[:PROBES]
        other = partners(probe, threshold, rng)
        met = np.zeros(len(probe), bool)
        differ = []
        while len(self.tables) < need or (min(met[0::2].mean(), met[1::2].mean()) < recall and len(self.tables) < 4 * need + 64):
            r = self._rotation()
            self.rotations.append(r)
            diff = self._code(probe, r) ^ self._code(other, r)
            differ.append(np.bitwise_count(diff))
            for s in range(self.width // self.k if self.k else 1):
                if len(self.tables) >= need and min(met[0::2].mean(), met[1::2].mean()) >= recall:
                    break
                self.tables.append((len(self.rotations) - 1, s * self.k))
                met |= (diff >> np.uint64(s * self.k)) & np.uint64((1 << self.k) - 1) == 0
        del self._data, self._rng
        #: Recall of the made pairs, and more bits than any of them differs in (the first code of a row is looked at).
        self.measured, self.radius = float(min(met[0::2].mean(), met[1::2].mean())), int(differ[0].max()) + 3

    def plan(self, flip: np.ndarray, per_label: int, recall: float) -> tuple[int, int]:
        """Bits of a key and number of tables: of those that reach `recall`, the ones of least work a row.

        Where no number up to MOST does (the vectors lie as close to their mean as to each other), one table of one key.
        """
        best = (math.inf, 0, 1)
        for k in range(1, min(self.width, 24) + 1):
            apart = 1 - (1 - flip) ** k  # in one table, by row of the sample
            few, many = 0, 1
            while many < MOST and 1 - (apart**many).mean() < recall:
                few, many = many, 2 * many
            while many - few > 1:
                mid = (few + many) // 2
                few, many = (few, mid) if 1 - (apart**mid).mean() >= recall else (mid, many)
            if many < MOST:  # a row of a table costs about as much as 64 comparisons
                best = min(best, (many * (64 + per_label / 2.0**k), k, many))
        return best[1:]

    def _rotation(self) -> np.ndarray:
        r = np.linalg.qr(self._rng.standard_normal((self.width, self.width)))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.sign(self._data @ r).T @ self._data)
            r = (left @ right).T
        return r

    def _code(self, unit: np.ndarray, r: np.ndarray) -> np.ndarray:
        return ((((unit - self.mean) @ self.axes) @ r > 0) * np.left_shift(np.uint64(1), np.arange(self.width, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One 64-bit code a rotation."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.stack([self._code(unit, r) for r in self.rotations], axis=1)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.k) - 1)
        return np.stack([(codes[:, c] >> np.uint64(s)) & mask for c, s in self.tables], axis=1)

    def first_here(self, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Of pairs of codes that meet in a table: those that don't meet in an earlier one."""
        diff, mask, ok = a ^ b, np.uint64((1 << self.k) - 1), np.ones(len(a), bool)
        for t, (c, s) in enumerate(self.tables[:-1]):
            ok &= (table <= t) | ((diff[:, c] >> np.uint64(s)) & mask != 0)
        return ok


def _coded(model: ItqTables):
    def run(incoming):
        for b in incoming:
            codes = model.codes(rows_of(b.column(2)))
            keys, n = model.keys(codes), b.num_rows
            ids, labels = (np.repeat(b.column(k).to_numpy(), len(model.tables)) for k in (0, 1))
            raw = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(np.repeat(np.arange(n), len(model.tables))))
            yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(np.tile(np.arange(len(model.tables), dtype=np.int32), n)), pa.array(keys.astype(np.int64).ravel()), pa.array(ids), raw], ["label", "t", "key", "gid", "codes"])

    return run


#: Columns of a block: label, t, key, bi, bj, mine, gid, codes, and for the comparison copies, embedding.
_KEYS = 5


def _close_pairs(model: ItqTables, t: pa.Table):
    """Pairs of a table of whole blocks that are near in Hamming distance and meet here first."""
    table, bi, bj, mine = (t.column(k).to_numpy() for k in (1, 3, 4, 5))
    codes = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint64).reshape(t.num_rows, -1)
    for i, j in pairs_in(group_starts(t, _KEYS), t.num_rows):
        ok = (bi[i] == bj[i]) | (mine[i] != mine[j])
        ok &= np.bitwise_count(codes[i, 0] ^ codes[j, 0]) <= model.radius
        i, j = i[ok], j[ok]
        ok = model.first_here(codes[i], codes[j], table[i])
        if ok.any():
            yield i[ok], j[ok]


def _having(model: ItqTables):
    """The rows of each block that have a close partner there."""

    def run(incoming):
        for t in runs(incoming, _KEYS):
            has = np.zeros(t.num_rows, bool)
            for i, j in _close_pairs(model, t):
                has[i] = has[j] = True
            if has.any():
                yield from t.filter(pa.array(has)).combine_chunks().to_batches()

    return run


def _compared(model: ItqTables, threshold: float):
    """For each row of a block: links counted here with the copies behind them, and the smallest id linked."""

    def run(incoming):
        for t in runs(incoming, _KEYS):
            ids, copies, x = t.column(6).to_numpy(), t.column(8).to_numpy(), rows_of(t.column(9))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            links, ii, jj = np.zeros(t.num_rows, np.int64), [], []
            for i, j in _close_pairs(model, t):
                ok = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)]) >= threshold
                i, j = i[ok], j[ok]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                ii.append(i)
                jj.append(j)
            if any(len(i) for i in ii):
                low, some = forest(t.num_rows, np.concatenate(ii), np.concatenate(jj), ids), links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(low[some]), pa.array(links[some])], ["gid", "low", "links"])

    return run


def near_vectors(rows: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label)."""
    spark = prepare(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    good = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    fit = rows.where(good)
    # the checkpoint fixes the numbers of the groups; a vec_id may have several
    one = cut(fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("gid", F.monotonically_increasing_id()))
    links = spark.createDataFrame([], "gid long, low long, links long")
    for (width,) in one.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect():
        ours = one.where(F.size("embedding") == width)
        per_label, total = ours.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
        taken = drawn(ours.select("first", "embedding"), ["first", "embedding"], sample, SEED, total).select("embedding").toArrow()
        model = ItqTables(rows_of(taken["embedding"], width), per_label, threshold)
        coded = ours.select("gid", "label", "embedding").mapInArrow(_coded(model), "label long, t int, key long, gid long, codes binary")
        block, order = ["label", "t", "key", "bi", "bj"], ["label", "t", "key", "bi", "bj", "mine", "gid", "codes"]
        dealt = blocked(coded, ["label", "t", "key"], "gid", BLOCK).select(*order).repartition(*block).sortWithinPartitions(*block, "gid")
        having = cut(dealt.mapInArrow(_having(model), dealt.schema))
        full = having.join(ours.select("gid", "copies", "embedding"), "gid").select(*order, "copies", "embedding")
        full = full.repartition(*block).sortWithinPartitions(*block, "gid")
        links = links.union(full.mapInArrow(_compared(model, threshold), "gid long, low long, links long"))
    links = cut(links)
    roots = components(links.select(F.col("gid").alias("a"), F.col("low").alias("b")))
    found = one.join(links.groupBy("gid").agg(F.sum("links").alias("links")), "gid", "left").join(roots.withColumnRenamed("node", "gid"), "gid", "left")
    found = cut(found.select("gid", "label", "embedding", "first", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "gid").alias("root")))
    least = cut(found.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("n")))
    named = cut(join_hot(found, least, ["root"], "gid", found.count()).select("label", "embedding", "links", "component", F.col("copies").alias("n")))
    met = join_hot(fit, named, ["label", "embedding"], "vec_id", named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).select("vec_id", "links", "component")
    out = met.union(rows.where(~good).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("vec_id")).alias("kept"))
