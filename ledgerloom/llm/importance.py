"""Resampling towards a target distribution by hashed n-gram importance weights (Xie et al., 2023), with long texts in chunks.

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z is lower-cased. The features of a text are its runs of 1
to `n` consecutive words joined by one space; a feature's bucket is the CRC-32 of its bytes modulo `buckets`. Counts of the
buckets over all documents and over all target texts give each bucket a gain; a document's weight is the floored mean gain
of its features, and Gumbel noise from its id turns drawing by weight into taking the highest scores.

A long text would hold up its task, so it is cut at word boundaries into chunks of `CHUNK` words. A chunk owns the features
that start in its words and carries the n - 1 words behind them, so each feature is counted once; chunks are dealt out over
all tasks, and counts and weights are summed by document. The corpus counts are one array of `buckets` numbers a task.

Ranks need no sort in one task: the noise spreads the documents over scores, so the ranks before a score come from the
counts by score (bounded by the range of scores), and those within it from a window over that score alone.

Defined cases: null and empty texts have no features and weight 0; every row is a document of its own, repeated ids too
(ties of score and id go to fewer features); a null id is hashed like an empty one and loses ties; an empty table gives no
rows, an empty target has counts of zero; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, cut, distinct, flat_bytes, prepare, span_hashes, word_spans, written

BUCKETS, N, SHARE, LEAST, SEED = 10_000, 2, 25, 20, 7
#: Words that a chunk owns, and the bytes from which a text is cut into chunks.
CHUNK, LONG = 20_000, 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.ones(256, bool)
_APART[48:58] = _APART[97:123] = _APART[128:] = False


def _zeros_operators(bits: int) -> list[np.ndarray]:
    """For each power of two: what so many zero bytes do to a CRC, as a table for each byte of it (CRCs are linear)."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & np.uint32(1), (byte >> np.uint32(1)) ^ np.uint32(0xEDB88320), byte >> np.uint32(1))
    values = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [(values >> np.uint32(8)) ^ byte[values & np.uint32(255)]]
    while len(out) < bits:
        out.append(_applied(out[-1], out[-1]))
    return out


def _applied(op: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return op[0][crc & np.uint32(255)] ^ op[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ op[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ op[3][crc >> np.uint32(24)]


_OPERATORS = _zeros_operators(31)
_SPACE = np.uint32(zlib.crc32(b" "))


def _followed(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of two strings end to end, from both CRCs and the length of the second."""
    out = crc.copy()
    for bit in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> bit & 1)
        out[on] = _applied(_OPERATORS[bit], out[on])
    return out ^ after


def features(texts, own: np.ndarray | None = None, n: int = N, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Document number and bucket of each feature that starts in the first `own` words of its text (all by default)."""
    raw, off = flat_bytes(texts)
    data = _LOWER[raw]
    start, end, before = word_spans(data, off, _APART)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, which = distinct(span_hashes(data, start, end))
    flat = data.tobytes()
    crc = np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)), np.uint32, len(first))[which]
    length, have = end - start, np.diff(before)
    doc = np.repeat(np.arange(len(have)), have)
    last = before[1:][doc]
    mine = np.arange(len(start))
    if own is not None:
        mine = mine[mine - before[:-1][doc] < own[doc]]
    spaced, docs, codes = _followed(crc, _SPACE, np.ones(len(crc), np.int64)), [doc[mine]], [crc[mine]]
    now = crc[mine]
    for k in range(1, n):
        ok = mine + k < last[mine]
        mine, now = mine[ok], now[ok]
        now = _followed(spaced[mine] if k == 1 else _followed(now, _SPACE, np.ones(len(now), np.int64)), crc[mine + k], length[mine + k])
        docs.append(doc[mine])
        codes.append(now)
    return np.concatenate(docs), np.concatenate(codes).astype(np.int64) % buckets


def _chunked(n: int, words: int):
    """The chunks of long texts: (doc_id, digest, chunk, own, text)."""

    def run(incoming):
        for b in batches(incoming):
            for i in range(b.num_rows):
                data, off = flat_bytes(b.column(2).slice(i, 1))
                start, end, _ = word_spans(_LOWER[data], off, _APART)
                cuts = range(0, max(1, len(start)), words)
                pieces = [data[start[a] : end[min(a + words + n - 1, len(start)) - 1]].tobytes().decode() if len(start) else "" for a in cuts]
                for a in range(0, len(pieces), 32):
                    part = pieces[a : a + 32]
                    at = pa.array([i] * len(part))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), b.column(1).take(at), pa.array(range(a, a + len(part)), pa.int64()), pa.array([words] * len(part), pa.int64()), pa.array(part, pa.string())],
                        ["doc_id", "digest", "chunk", "own", "text"],
                    )

    return run


def chunks(docs: DataFrame, *, n: int = N, words: int = CHUNK, long: int = LONG) -> DataFrame:
    """(doc_id, digest, chunk, own, text): short texts as they are, long ones in chunks dealt out over all tasks."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    short = rows.where(size <= long).select("doc_id", "digest", F.lit(0).cast("long").alias("chunk"), F.lit(1 << 40).alias("own"), "text")
    cut_up = rows.where(size > long).mapInArrow(_chunked(n, words), "doc_id long, digest long, chunk long, own long, text string")
    return short.union(cut_up.repartition("doc_id", "digest", "chunk"))


def bucket_counts(pieces: DataFrame, *, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all chunks; a task gives at most one row for each bucket."""

    def run(incoming):
        total = np.zeros(buckets, np.int64)
        for b in batches(incoming):
            total += np.bincount(features(b.column(1), b.column(0).to_numpy(), n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = pieces.select("own", "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed share in the target over that in the corpus), for each bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gains: np.ndarray, n: int):
    def run(incoming):
        for b in batches(incoming):
            doc, bucket = features(b.column(4), b.column(3).to_numpy(), n, len(gains))
            count = np.bincount(doc, minlength=b.num_rows)
            total = np.zeros(b.num_rows, np.int64)
            np.add.at(total, doc, gains[bucket])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(count), pa.array(total)], ["doc_id", "digest", "chunk", "n", "gain"])

    return run


def weights(docs: DataFrame, target: DataFrame, *, n: int = N, buckets: int = BUCKETS, words: int = CHUNK, long: int = LONG) -> DataFrame:
    """doc_id, n_features, weight of each row of `docs` (doc_id, text) against the texts of `target` (text)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    goal = target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = chunks(docs, n=n, words=words, long=long)
    gains = bucket_gains(bucket_counts(pieces, n=n, buckets=buckets), bucket_counts(chunks(goal, n=n, words=words, long=long), n=n, buckets=buckets))
    scored = pieces.mapInArrow(_weighed(gains, n), "doc_id long, digest long, chunk long, n long, gain long")
    # rows of equal id and text add up and are told apart again afterwards
    whole = scored.groupBy("doc_id", "digest").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"), F.count_if(F.col("chunk") == 0).alias("copies"))
    mean = F.floor(F.expr("(gain - pmod(gain, n)) div n"))
    each = whole.select("doc_id", F.expr("n div copies").alias("n_features"), F.when(F.col("n") > 0, mean).otherwise(0).cast("long").alias("weight"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "n_features", "weight")


def resample(docs: DataFrame, target: DataFrame, *, share: int = SHARE, least: int = LEAST, seed: int = SEED, n: int = N, buckets: int = BUCKETS, words: int = CHUNK, long: int = LONG) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the rank of the drawn documents, null for the others."""
    noise = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    # n runs start at each word, but for those that the end cuts off
    fewest = sum(max(0, least - k) for k in range(n))
    scored = written(
        weights(docs, target, n=n, buckets=buckets, words=words, long=long)
        .withColumn("score", (F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(noise)))).cast("long"))
        .withColumn("fit", (F.col("n_features") >= fewest) & (F.col("n_features") > 0))
    )
    fit = scored.where("fit")
    draw = fit.count() * share // 100
    by_score = cut(fit.groupBy("score").agg(F.count(F.lit(1)).alias("k")))
    # scores lie within some tens of thousands of each other whatever the rows: gains and noise are logarithms
    before = by_score.select("score", (F.sum("k").over(W.orderBy(F.desc("score"))) - F.col("k")).alias("before")).where(F.col("before") < draw)
    place = F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features"))
    ranked = fit.join(before, "score").withColumn("rank", (F.col("before") + place).cast("long"))
    drawn = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    rest = scored.join(before.select("score", F.lit(True).alias("fit")), ["score", "fit"], "left_anti")
    return drawn.union(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))
