"""Substring deduplication by hashing units of text: lines, and sentences within lines.

A unit is a run of words that ends with a line or with a word that ends in `.`, `!` or `?`. It is normalised (capital
A-Z to small letters, one space between words) and digested to 128 bits. A unit of fewer than `least` words is digested
together with the units after it, up to `least` words, so that passages of short lines or sentences count as well.
Digests are grouped over the whole corpus; the occurrence that comes first by (doc_id, start) is kept, all others are
removed. Removed units that follow each other become one span. A passage often begins and ends inside a sentence of its
host: so a span grows to both sides as long as the words beside it equal those beside its kept occurrence, up to a whole
unit a side. Offsets are code points of the original text, end exclusive. What stays: a passage that is less than a
whole unit in both hosts, and units of fewer than `least` words on their own.

Defined cases: null and empty texts have no units; rows of equal doc_id are one document, whose units don't count as
repeats of each other at the same place (spans grow by the least of its texts); null ids are left alone; an empty table gives no rows; other columns are
ignored by `repeated_spans` and kept by `without_repeats`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, cut, flat_bytes, forget, fresh, in_map, join_hot, mix64, prepare, ragged, span_hashes, word_spans, written

LEAST = 6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = 0x9E3779B97F4A7C15


def units(texts) -> dict[str, np.ndarray]:
    """Of each unit the document number, start and end in code points, words, number of its first word, and two 64-bit
    digests; of each word its hash and its start and end in code points."""
    raw, off = flat_bytes(texts)
    data = _LOWER[raw]
    start, end, before = word_spans(data, off)
    n = len(start)
    if not n:
        return {k: np.zeros(0, np.int64) for k in ("doc", "start", "end", "words", "first", "d1", "d2", "hash", "word_start", "word_end")}
    doc = np.repeat(np.arange(len(off) - 1), np.diff(before))
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    closes = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8))
    closes[:-1] |= (lines[start[1:]] > lines[end[:-1]]) | (doc[1:] != doc[:-1])
    closes[-1] = True
    last = np.flatnonzero(closes)
    first = np.concatenate(([0], last[:-1] + 1))
    place = (np.arange(n) - np.repeat(first, last - first + 1)).astype(np.uint64)
    h = span_hashes(data, start, end)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    base = points[off[doc]]
    out = {"doc": doc[first], "words": last - first + 1, "first": first, "hash": h, "word_start": points[start] - base, "word_end": points[end] - base}
    out |= {"start": out["word_start"][first], "end": out["word_end"][last]}
    for name, salt in (("d1", 1), ("d2", _GOLD)):
        term = mix64(mix64(h ^ np.array([salt], np.uint64)) + place * np.array([_GOLD], np.uint64))
        out[name] = mix64(np.add.reduceat(term, first) + out["words"].astype(np.uint64)).view(np.int64)
    return out


def joined(u: dict[str, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """For each unit that has `least` words together with those after it in its document: its number, the number of the
    last unit it takes, and the digests of all of them."""
    total = np.concatenate(([0], np.cumsum(u["words"])))
    last = np.searchsorted(total, total[:-1] + least) - 1
    at = np.flatnonzero(last < len(last))
    at = at[u["doc"][last[at]] == u["doc"][at]]
    last = last[at]
    out = {}
    for name in ("d1", "d2"):
        d = u[name].view(np.uint64)
        both = d[at].copy()
        for k in range(1, int((last - at).max(initial=0)) + 1):
            more = np.flatnonzero(last - at >= k)
            both[more] += mix64(d[at[more] + k] + np.array([k * _GOLD & (1 << 64) - 1], np.uint64))
        out[name] = both.view(np.int64)
    return at, last, out


def _units(least: int):
    def run(incoming):
        for b in batches(incoming):
            u = units(b.column(1))
            at, last, digests = joined(u, least)
            doc = u["doc"][at]
            k = np.arange(len(u["doc"])) - np.searchsorted(u["doc"], u["doc"])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(k[at]), pa.array(u["start"][at]), pa.array(u["end"][last]), *map(pa.array, digests.values())], ["doc_id", "k", "start", "end", "d1", "d2"])

    return run


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of consecutive runs of `values` as one binary each."""
    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _beside(incoming):
    """For (doc_id, text, asked: positions and sides): hashes of the words of the unit before or after each position, the
    nearest first, and where a span reaches that takes them in. Positions that no unit begins or ends at have none."""
    for b in batches(incoming):
        u = units(b.column(1))
        asked = b.column(2)
        row = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()))
        pos, after = (asked.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        n, wide = len(u["doc"]), np.int64(1) << 40
        starts, ends = u["doc"] * wide + u["start"], u["doc"] * wide + u["end"]
        # the unit before a start, the unit after an end, in the same document
        near = np.where(after, np.searchsorted(ends, row * wide + pos) + 1, np.searchsorted(starts, row * wide + pos) - 1)
        here = np.where(after, near - 1, near + 1)
        ok = (near >= 0) & (near < n) & (here < n)
        ok[ok] = u["doc"][near[ok]] == row[ok]
        ok[ok] &= np.where(after[ok], ends[here[ok]], starts[here[ok]]) == row[ok] * wide + pos[ok]
        row, pos, after, near = row[ok], pos[ok], after[ok], near[ok]
        size, first = (u[c][near] if n else near for c in ("words", "first"))
        at = ragged(first, size)
        back = np.repeat(2 * first + size - 1, size) - at  # the same words from the last to the first
        side = np.repeat(after, size)
        at = np.where(side, at, back)
        reach = np.where(side, u["word_end"][at], u["word_start"][at]) if len(at) else at
        words = u["hash"][at].view(np.uint64).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(pos), pa.array(after), _packed(words, size), _packed(reach.astype(np.int32), size)], ["doc_id", "pos", "after", "words", "reach"])


def _grown(incoming):
    """For (doc_id, run, after, pos, least, words, reach, kept_words): how far the span reaches on that side."""
    for b in batches(incoming):
        after, pos, least = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
        out = []
        for i, (mine, reach, theirs) in enumerate(zip(*(b.column(c).to_pylist() for c in (5, 6, 7)), strict=True)):
            x, y = np.frombuffer(mine, np.uint32), np.frombuffer(theirs, np.uint32)
            m = min(len(x), len(y))
            same = x[:m] == y[:m]
            reached = np.frombuffer(reach, np.int32)[: m if same.all() else int(np.argmin(same))]
            if not after[i]:
                reached = reached[reached >= least[i]]
            out.append(int(reached[-1]) if len(reached) else pos[i])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())], ["doc_id", "run", "after", "to"])


def _runs(found: DataFrame) -> DataFrame:
    """Repeated units that follow each other as one row, with the kept occurrences of the first and of the last."""
    firsts = cut(found.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "start", "end")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    again = join_hot(found, firsts, ["d1", "d2"], "doc_id", found.count()).where("doc_id <> kept.doc_id or start <> kept.start").drop("d1", "d2")
    again = again.repartition("doc_id").dropDuplicates(["doc_id", "start"])  # one exchange for this, the window and the groups
    runs = again.withColumn("run", F.col("k") - F.row_number().over(W.partitionBy("doc_id").orderBy("k")))
    return runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.min_by("kept", "start").alias("first"), F.max_by("kept", "start").alias("last"))


def repeated_spans(docs: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans to remove: doc_id, start, end, n_units, and kept_doc_id, kept_start of the first unit's kept occurrence."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    found = written(rows.mapInArrow(_units(least), "doc_id long, k long, start long, end long, d1 long, d2 long"))
    runs = cut(_runs(found))
    forget(docs.sparkSession, found)
    side = lambda after, pos, kept_doc, kept_pos, least: F.struct(F.lit(after).alias("after"), F.col(pos).alias("pos"), F.col(kept_doc).alias("kept_doc"), F.col(kept_pos).alias("kept_pos"), least.cast("long").alias("least"))
    floor = F.when(F.col("first.doc_id") == F.col("doc_id"), F.col("first.end")).otherwise(0)  # the kept occurrence itself stays
    sides = F.explode(F.array(side(False, "start", "first.doc_id", "first.start", floor), side(True, "end", "last.doc_id", "last.end", F.lit(0))))
    sides = runs.select("doc_id", "run", sides.alias("s")).select("doc_id", "run", "s.*")
    wanted = sides.groupBy(F.col("kept_doc").alias("doc_id"), F.col("kept_pos").alias("pos"), "after").agg(F.count(F.lit(1)).alias("n"))
    asked = cut(sides.select("doc_id", "pos", "after").union(wanted.select("doc_id", "pos", "after")).groupBy("doc_id").agg(F.collect_set(F.struct("pos", "after")).alias("asked")))
    texts = in_map(rows, asked.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    beside = written(texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_beside, "doc_id long, pos long, after boolean, words binary, reach binary"))
    kept = cut(wanted.join(beside.drop("reach"), ["doc_id", "pos", "after"]).select(F.col("doc_id").alias("kept_doc"), F.col("pos").alias("kept_pos"), "after", F.col("words").alias("kept_words"), "n"))
    own = sides.join(beside, ["doc_id", "pos", "after"]).select("doc_id", "run", "after", "pos", "least", "words", "reach", "kept_doc", "kept_pos")
    met = join_hot(own, kept, ["kept_doc", "kept_pos", "after"], "doc_id", runs.count()).select("doc_id", "run", "after", "pos", "least", "words", "reach", "kept_words")
    reach = met.mapInArrow(_grown, "doc_id long, run long, after boolean, to long").groupBy("doc_id", "run").agg(F.min(F.when(~F.col("after"), F.col("to"))).alias("a"), F.max(F.when(F.col("after"), F.col("to"))).alias("b"))
    grown = runs.join(reach, ["doc_id", "run"], "left").select("doc_id", F.coalesce("a", "start").alias("start"), F.coalesce("b", "end").alias("end"), "n_units", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))
    # spans that overlap after growing become one
    before = F.max("end").over(W.partitionBy("doc_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    part = F.sum("new").over(W.partitionBy("doc_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0))
    merged = grown.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("part", part)
    return merged.groupBy("doc_id", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_units").alias("n_units"),
        F.min_by("kept_doc_id", F.struct("start", "end")).alias("kept_doc_id"), F.min_by("kept_start", F.struct("start", "end")).alias("kept_start"),
    ).drop("part")


def without_repeats(docs: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`; `text_col` without the repeated spans, and `removed_spans` with their original offsets."""
    name, key = fresh(docs, "removed_spans"), fresh(docs, "span_doc")
    spans = repeated_spans(docs, least=least, id_col=id_col, text_col=text_col)
    of = spans.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))
    met = docs.join(of, F.col(id_col).cast("long") == F.col(key), "left").drop(key)
    text = F.col(text_col)
    edge = lambda i: F.coalesce(F.get(F.col(name), i - 1)["end"], F.lit(0))
    kept = F.transform(F.col(name), lambda s, i: F.substr(text, (edge(i) + 1).cast("int"), (s["start"] - edge(i)).cast("int")))
    rest = F.substr(text, (F.element_at(F.col(name), -1)["end"] + 1).cast("int"))
    return met.withColumn(text_col, F.when(F.col(name).isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest)))
