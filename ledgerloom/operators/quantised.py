"""A vector index of 4-bit codes: scanned first, then the exact vectors of those that can still be among the best.

A vector is made a unit vector and cut to whole steps of its own scale (-7 to 7), two to a byte. The index keeps the codes, the
scale and the length of what the cut left out. With a unit query q, the cosine lies within that length of the product of q with
the decoded vector (Cauchy and Schwarz), so a vector whose upper bound is below the k-th best lower bound of a query can't be
among its k best, ties included. Only the others are read and scored in double precision: the result is that of a full search.

The index lies in buckets by a hash of the id. `refresh` digests the rows of every bucket and writes the changed ones only, as
new files; a small manifest then names the files that count, so a refresh that fails leaves the old state.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, are neither indexed nor found, and
such a query finds nothing. An id stands for one vector; vectors of one index and its queries have one length.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CODES = "doc_id long, code binary, scale double, rest double"
#: Rows of a block of codes, and queries that meet it at once: a meeting is one matrix product of bounded size.
BLOCK, QUERIES = 8_192, 512
#: What double arithmetic may add to a product, far above its rounding.
SLACK = 1e-9


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector can be compared."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(x, lambda v: v != 0)


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return (F.conv(F.left(F.md5(doc_id.cast("string")), F.lit(6)), 16, 10).cast("long") % buckets).cast("int")


def _units(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # a length can't overflow or vanish then
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encoded(vectors: DataFrame) -> DataFrame:
    """doc_id, code, scale, rest for (doc_id, embedding)."""

    def encode(parts):
        for rows in parts:
            if rows.empty:
                continue
            x = _units(rows["embedding"])
            scale = np.abs(x).max(axis=1) / 7
            steps = np.rint(x / scale[:, None])
            rest = np.linalg.norm(x - steps * scale[:, None], axis=1)
            odd = steps.shape[1] % 2
            halves = np.pad(steps + 8, ((0, 0), (0, odd))).astype(np.uint8)
            packed = halves[:, ::2] << 4 | halves[:, 1::2]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "code": [r.tobytes() for r in packed], "scale": scale, "rest": rest})

    return vectors.where(usable()).select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").mapInPandas(encode, CODES)


def _decoded(rows: pd.DataFrame, size: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
    steps = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(rows), -1)[:, :size]
    return (steps.astype(float) - 8) * rows["scale"].to_numpy()[:, None]


def candidates(codes: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, at_once: int = QUERIES) -> DataFrame:
    """query_id, doc_id of every vector that may be among the k best of a query, from the codes alone.

    Two scans: the first gives a query's k best lower bounds of each block, of which the k-th best of all is its line; the
    second gives the vectors whose upper bound reaches it, so no block sends on more than the line lets through.
    """
    asked = queries.where(usable()).select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    blocks, pieces = max(1, -(-codes.count() // block)), max(1, -(-asked.count() // at_once))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = codes.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), every(pieces).alias("piece"), "doc_id", "code", "scale", "rest")
    dealt = lambda qs: qs.select(every(blocks).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(pieces)).alias("piece"), "*")

    def products(queries: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
        q = _units(queries["embedding"])
        said = q @ _decoded(rows, q.shape[1]).T
        said[queries["query_id"].to_numpy()[:, None] == rows["doc_id"].to_numpy()[None]] = -np.inf
        return said

    def lows(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "low": []})
        low = products(queries, rows)
        low -= rows["rest"].to_numpy() + SLACK
        n = min(k, low.shape[1])
        low.partition(low.shape[1] - n, axis=1)
        out = pd.DataFrame({"query_id": np.repeat(queries["query_id"].to_numpy(), n), "low": low[:, -n:].ravel()})
        return out[np.isfinite(out["low"])]

    def reach(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "doc_id": []})
        high = products(queries, rows)
        high += rows["rest"].to_numpy() + SLACK
        i, j = np.nonzero((high >= queries["line"].to_numpy()[:, None]) & np.isfinite(high))
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[i], "doc_id": rows["doc_id"].to_numpy()[j]})

    met = lambda qs, fn, schema: dealt(qs).groupBy("block", "piece").cogroup(held.groupBy("block", "piece")).applyInPandas(fn, schema)
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("low")))
    best = met(asked, lows, "query_id long, low double").withColumn("i", nth).where(F.col("i") <= k)
    line = best.groupBy("query_id").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n"))
    # fewer than k in all: each of them stays
    drawn = F.when(F.col("n") == k, F.col("low")).otherwise(float("-inf"))
    return met(asked.join(line, "query_id").select("query_id", "embedding", drawn.alias("line")), reach, "query_id long, doc_id long")


def search(codes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, at_once: int = QUERIES) -> DataFrame:
    """query_id, doc_id, score (cosine): the candidates of every query, scored by their own vectors; for a top k."""
    found = candidates(codes, queries, k, block, at_once)
    own = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").alias("v"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v")))
    return found.join(own, "doc_id").join(asked, "query_id").select("query_id", "doc_id", cosine.alias("score"))


class VectorIndex:
    """The codes of a table of vectors, kept under `path`. One writer at a time."""

    SCHEMA = "bucket int, digest string, folder string, version int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _manifest(self) -> tuple[int, dict[int, tuple[str, str]]]:
        """The last version and, of each bucket that has rows, digest and folder (a row for each bucket, their number fixed)."""
        try:
            every = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        last = every.agg(F.max("version")).first()[0] or 0
        return last, {r.bucket: (r.digest, r.folder) for r in every.where((F.col("version") == last) & F.col("folder").isNotNull()).collect()}

    def refresh(self, vectors: DataFrame) -> list[int]:
        """Bring the index in line with (doc_id, embedding); gives the buckets that were written anew or went away."""
        rows = vectors.where(usable()).select("doc_id", "embedding").withColumn("bucket", bucket_of(F.col("doc_id"), self.buckets))
        one = F.xxhash64("doc_id", "embedding")
        marks = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(F.pmod(one, F.lit(2**31 - 1))).alias("s"))
        now = {r.bucket: f"{r.n}:{r.x}:{r.s}" for r in marks.collect()}  # one row a bucket
        version, had = self._manifest()
        changed = [b for b, digest in now.items() if b not in had or had[b][0] != digest]
        gone = [b for b in had if b not in now]
        if not changed and not gone:
            return []
        folder = f"data/{uuid.uuid4().hex}"
        if changed:
            codes = encoded(rows.where(F.col("bucket").isin(changed))).withColumn("bucket", bucket_of(F.col("doc_id"), self.buckets))
            codes.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        kept = {b: x for b, x in had.items() if b in now and b not in changed} | {b: (now[b], folder) for b in changed}
        state = [(b, digest, f, version + 1) for b, (digest, f) in kept.items()] or [(-1, None, None, version + 1)]
        self.spark.createDataFrame(state, self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return sorted(changed + gone)

    def codes(self) -> DataFrame:
        """doc_id, code, scale, rest of all indexed vectors."""
        paths = [f"{self.path}/{folder}/bucket={b}" for b, (_, folder) in sorted(self._manifest()[1].items())]
        return self.spark.read.schema(CODES).parquet(*paths) if paths else self.spark.createDataFrame([], CODES)
