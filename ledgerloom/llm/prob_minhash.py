"""Near-duplicate documents by ProbMinHash (Ertl, 2020): weighted word shingles, banding, exact verification.

A document is the multiset of its five-word shingles (words: runs of non-space bytes, lower-cased); a text of one to
four words is one shingle. Each distinct shingle d of weight w emits the points of a Poisson process of rate w, seeded
by d alone; each point falls into one of `REGISTERS` registers, which keep their earliest point. Two documents agree
in a register with the probability Jaccard similarity of their weights. An element stops as soon as its next point is
later than all its document's registers (early termination).

A link is about sets, so a document in which a shingle repeats has a second signature with all weights 1; where none
does, both are the same. The bands of both are keys of one kind, so each pair can meet by its sets.

Equal word sequences are grouped first by a 128-bit digest, so only one representative of exact copies goes on.
Bands of `ROWS` registers form buckets. In a bucket every member is compared with the smallest id (a star, no pairs
within the bucket); only those that fail there are compared with all members of it, in blocks of bounded size that
give a spanning forest of the links. A link holds if the Jaccard similarity of the sets of distinct shingles is at
least `threshold`; shingles are told apart by 32 bits there, which errs by about n / 2**32 for sets of n shingles.
Classes are the connected components of the links.

Hot keys: digests and bands that a large share of all rows have are salted (`join_hot`); leaders of many pairs are salted.

Defined cases: a null or empty text (no words) is a class of its own; rows of equal doc_id are one document and share
its class (the smallest of their digests' classes); a null doc_id gives class null; an empty table gives no rows; other
columns are ignored by `near_duplicates` and kept by `deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, flat_bytes, forget, fresh, join_hot, mix64, prepare, ragged, span_hashes, unit_interval, word_spans, written
from .components import components
from .vectors import forest, group_starts, runs

WORDS, THRESHOLD = 5, 0.8
#: 25 bands of 5 registers: a pair whose sets have similarity 0.8 shares a band of sets with probability 0.99995.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Rows of a block of a bucket whose members must be compared, and pairs of a leader that one task takes.
BLOCK, STAR = 300, 10_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SHARE = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, before: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, 48-bit hash and count of each distinct shingle, sorted by both; `before` as of word_spans."""
    have = np.diff(before)
    n = np.where(have >= words, have - words + 1, np.minimum(have, 1))
    doc = np.repeat(np.arange(len(have)), n)
    at = ragged(before[:-1], n)
    span = np.minimum(have, words)[doc]
    total = span.astype(np.uint64)
    for k in range(words):
        inside = span > k
        total += np.where(inside, hashes[np.where(inside, at + k, 0)] * _SHARE[k], np.uint64(0)) if len(at) else total
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (mix64(total) >> np.uint64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    where = np.flatnonzero(new)
    return (key[where] >> np.uint64(48)).astype(np.int64), key[where] & np.uint64((1 << 48) - 1), np.diff(np.append(where, len(key)))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (docs x registers): the element whose point came first in each register, 0 in documents without elements."""
    first = np.full(docs * registers, np.inf)
    won = np.zeros(docs * registers, np.uint64)
    base, rate, x = mix64(element * _GOLD + _GOLD), weight.astype(np.float64), np.zeros(len(element))
    live, step = np.arange(len(element)), 0
    while len(live):
        step += 1
        h = mix64(base[live] + (np.array([step], np.uint64) * _GOLD))
        t = x[live] - np.log(unit_interval(h)) / rate[live]
        x[live] = t
        at = doc[live] * registers + (mix64(h) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, t)
        hit = first[at] == t
        won[at[hit]] = element[live][hit]
        latest = first.reshape(docs, registers).max(axis=1)
        live = live[t < latest[doc[live]]]
    return won.reshape(docs, registers)


def _digests(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit polynomials over each document's word hashes."""
    out = []
    for salt in (np.uint64(0), _GOLD):
        place = np.arange(len(hashes)) - np.repeat(before[:-1], np.diff(before))
        term = mix64(mix64(hashes ^ salt) + place.astype(np.uint64) * (_GOLD | np.uint64(1)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
        out.append(mix64(total[before[1:]] - total[before[:-1]] + np.diff(before).astype(np.uint64)))
    return out[0], out[1]


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    data, off = flat_bytes(pc.utf8_lower(texts))
    start, end, before = word_spans(data, off)
    return span_hashes(data, start, end), before


def _band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        keys = mix64(keys + sig[:, k::ROWS] + np.array([k + 1], np.uint64) * _GOLD)
    return mix64(keys ^ mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])


def _sign(incoming):
    for b in batches(incoming):
        hashes, before = _words(b.column(1))
        d1, d2 = _digests(hashes, before)
        doc, element, weight = shingles(hashes, before)
        keys = _band_keys(prob_minhash(doc, element, weight, b.num_rows))
        again = np.unique(doc[weight > 1])
        mine = np.flatnonzero(np.isin(doc, again))
        sets = _band_keys(prob_minhash(np.searchsorted(again, doc[mine]), element[mine], np.ones(len(mine)), len(again)))
        size = np.full(b.num_rows, BANDS)
        size[again] += BANDS
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = np.empty(ends[-1], np.uint64)
        flat[ragged(ends[:-1], np.full(b.num_rows, BANDS))] = keys.ravel()
        flat[ragged(ends[again] + BANDS, np.full(len(again), BANDS))] = sets.ravel()
        some = np.diff(before) > 0
        bands = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(some), bands], ["doc_id", "d1", "d2", "some", "bands"])


def _sets(incoming):
    for b in batches(incoming):
        doc, element, _ = shingles(*_words(b.column(1)))
        small = (mix64(element) >> np.uint64(32)).astype(np.uint32)
        cutting = np.searchsorted(doc, np.arange(b.num_rows + 1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(small[cutting[i] : cutting[i + 1]]).tobytes() for i in range(b.num_rows)], pa.binary())], ["id", "grams"])


def _numbered(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit values of each row's set with the row's number above them, ascending, and the sizes of the sets."""
    raw = sets.cast(pa.large_binary())
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    size = np.diff(off) // 4
    data = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32) if size.sum() else np.zeros(0, np.uint32)
    return (np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(32)) | data, size


def alike(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Jaccard similarity of the sets in each row of two binary columns; all rows of a batch by one merge."""
    (p, n), (q, m) = _numbered(x), _numbered(y)
    both = np.concatenate((p, q))
    both.sort(kind="stable")  # two ascending runs
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(n)) if len(both) else np.zeros(len(n), np.int64)
    return common / np.maximum(1, n + m - common)


def _verify(threshold: float):
    def run(incoming):
        for b in batches(incoming):
            good = alike(b.column(2), b.column(3)) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(good)], ["lead", "rep", "good"])

    return run


def _within(threshold: float):
    """Links of the rows that failed with the members of their bucket: (id, least id it is linked with in the block).

    Rows (key, fi, ai, failed, id, grams): block fi of the failed rows meets block ai of all members.
    """

    def run(incoming):
        for t in runs(incoming, 3):
            starts = group_starts(t, 3).tolist()
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                bad, ids = t.column(3)[lo:hi].to_numpy(), t.column(4)[lo:hi].to_numpy()
                sets = [np.frombuffer(x, np.uint32) for x in t.column(5)[lo:hi].to_pylist()]
                size = np.array([len(x) for x in sets])
                every, which = np.unique(np.concatenate(sets), return_inverse=True)
                ends = np.concatenate(([0], np.cumsum(size)))
                ii, jj = [], []
                for i in np.flatnonzero(bad).tolist():
                    mark = np.zeros(len(every), bool)
                    mark[which[ends[i] : ends[i + 1]]] = True
                    both = np.add.reduceat(mark[which], ends[:-1], dtype=np.int64)
                    j = np.flatnonzero((both >= threshold * (size + size[i] - both)) & (ids != ids[i]))
                    ii.append(np.full(len(j), i))
                    jj.append(j)
                i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ii, jj))
                low = forest(hi - lo, i, j, ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids[low != ids]), pa.array(low[low != ids])], ["a", "b"])

    return run


def _meetings(members: DataFrame, block: int) -> DataFrame:
    """For (key, rep, failed): the rows of all blocks in which failed rows meet members; a key's f failed and n other
    rows take about f * n / block copies, and keys without failures none."""
    per = F.ceil(F.count(F.lit(1)) / block).cast("int").alias("all_blocks"), F.ceil(F.count(F.when(F.col("failed"), 1)) / block).cast("int").alias("bad_blocks")
    counts = cut(members.groupBy("key").agg(*per, F.count(F.lit(1)).alias("n")).where("bad_blocks > 0"))
    met = join_hot(members, counts, ["key"], "rep", members.count())
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = met.where("failed").select("key", mine("bad_blocks").alias("fi"), spread("all_blocks").alias("ai"), F.lit(True).alias("failed"), "rep")
    told = met.select("key", spread("bad_blocks").alias("fi"), mine("all_blocks").alias("ai"), F.lit(False).alias("failed"), "rep")
    return asks.union(told)


def _copies(signed: DataFrame) -> DataFrame:
    """(doc_id, rep) of the documents whose word sequence a smaller id has."""
    copies = cut(signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_hot(signed.select("doc_id", "d1", "d2"), copies, ["d1", "d2"], "doc_id", signed.count()).select("doc_id", "rep").where("doc_id <> rep")


def _with_leads(pairs: DataFrame, sets: DataFrame, star: int) -> DataFrame:
    """`pairs` (lead, rep, y) with the leader's set x; a leader of many pairs is dealt to several tasks."""
    salts = F.ceil(F.col("n") / star).cast("int")
    many = cut(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))).withColumn("salts", salts)
    by_lead = sets.select(F.col("id").alias("lead"), F.col("grams").alias("x")).join(many, "lead")
    by_lead = by_lead.select("lead", "x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = join_hot(pairs, many, ["lead"], "rep", pairs.count()).select("lead", "rep", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"))
    held = dealt.join(sets.select(F.col("id").alias("rep"), F.col("grams").alias("y")), "rep")
    return held.join(by_lead, ["lead", "salt"]).select("lead", "rep", "x", "y")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK, star: int = STAR) -> DataFrame:
    """One row for each document: doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id)."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = texts.where("doc_id is not null")
    signed = written(known.mapInArrow(_sign, "doc_id long, d1 long, d2 long, some boolean, bands array<long>")).where("some")
    members = cut(_copies(signed).groupBy("doc_id").agg(F.min("rep").alias("rep")))
    alone = signed.join(members.select("doc_id"), "doc_id", "left_anti")
    keyed = alone.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")).distinct()
    leads = cut(keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = leads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    left = cut(join_hot(keyed, leads, ["key"], "rep", total))
    wanted = left.select(F.col("rep").alias("doc_id")).distinct()
    grams = written(known.join(wanted, "doc_id").mapInArrow(_sets, "id long, grams binary").dropDuplicates(["id"]))
    pairs = cut(left.where("rep <> lead").select("lead", "rep").distinct())
    judged = cut(_with_leads(pairs, grams, star).mapInArrow(_verify(threshold), "lead long, rep long, good boolean"))
    failed = cut(left.join(judged.where("not good").select("lead", "rep"), ["lead", "rep"]).select("key", "rep", F.lit(True).alias("failed")))
    bad = cut(leads.join(failed.select("key").distinct(), "key").select("key", "n"))
    rest = join_hot(left.select("key", "rep"), bad, ["key"], "rep", total).join(failed, ["key", "rep"], "left")
    rest = cut(rest.select("key", "rep", F.coalesce("failed", F.lit(False)).alias("failed")))
    order = ["key", "fi", "ai"]
    held = _meetings(rest, block).join(grams.withColumnRenamed("id", "rep"), "rep").select(*order, "failed", "rep", "grams")
    within = held.repartition(*order).sortWithinPartitions(*order, "rep").mapInArrow(_within(threshold), "a long, b long")
    links = members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).union(judged.where("good").select("rep", "lead")).union(within)
    roots = components(links).select(F.col("node").alias("doc_id"), F.col("root"))
    forget(docs.sparkSession, signed)
    forget(docs.sparkSession, grams)
    out = texts.select("doc_id").join(roots, "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), (F.coalesce("root", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, one of each class."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, threshold=threshold).where("not kept").select("doc_id").distinct()
    name = fresh(docs, "gone_id")
    return docs.join(gone.withColumnRenamed("doc_id", name), F.col(id_col).cast("long") == F.col(name), "left_anti")
