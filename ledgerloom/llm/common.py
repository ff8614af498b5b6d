"""Helpers shared by the training-data operators: sessions, durable intermediates, columnar text hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes of an Arrow batch that a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, whatever the length of the texts; let workers import this package wherever they run."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(":"):  # where the workers see the same folders; otherwise the package comes by --py-files
        spark.sparkContext.environment["PYTHONPATH"] = f"{_ROOT}:{paths}".rstrip(":")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; one of our own only where all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or f"file://{tempfile.gettempdir()}/ledgerloom-shared"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive lost executors, the lineage ends here."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    out = df.checkpoint(eager=True)
    sc._jvm.System.gc()  # Spark deletes shuffle files of dropped plans only once the driver's garbage is collected
    return out


def written(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder, for intermediates that are large or read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of `written` that nothing reads any more; what was made from it must be cut or written itself."""
    root = shared_dir(spark)
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.rpartition("/")[2].startswith("stage-") and path.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: A key that more than a HOT-th of all rows have is hot; there can't be more than HOT of them.
HOT = 1000


def join_hot(rows: DataFrame, values: DataFrame, keys: list[str], by: str, total: int) -> DataFrame:
    """Inner join of `rows` with `values` (one row a key; its column `n` counts the key's rows) without a hot key in one task.

    The hot keys, at most HOT, are broadcast with a number of salts, so that a key and salt have about total / HOT rows;
    the salt of a row comes from its column `by`. `n` is dropped. `values` is read twice: cut it before.
    """
    most, salt, salts = max(1, total // HOT), fresh(rows, "salt"), fresh(rows, "salts")
    per = F.ceil(F.col("n") / most).cast("int")
    hot = values.where(F.col("n") > most).select(*keys, per.alias(salts))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.pmod(F.xxhash64(by), F.coalesce(salts, F.lit(1))).cast("int")).drop(salts)
    return dealt.join(values.withColumn(salt, F.explode(F.sequence(F.lit(0), per - 1))).drop("n"), [*keys, salt]).drop(salt)


#: Bits of the map of `in_map`: 8 MB, whatever the input.
BITS = 1 << 26


def in_map(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` is one of `keys`, and few others: those whose hash falls on the same bit of a broadcast map.

    What only a small part of a wide table is wanted for need not shuffle the rest; the map has a fixed size, and lets more
    rows through as keys become as many as its bits. A join or group afterwards tells the others apart.
    """
    at = F.pmod(F.xxhash64(key), F.lit(BITS))
    bucket, bits = fresh(rows, "map_bucket"), fresh(rows, "map_bits")
    grid = keys.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    met = rows.withColumn(bucket, F.bitmap_bucket_number(at)).join(F.broadcast(cut(grid)), bucket)
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substr(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop(bucket, bits)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def crc_fold(col: Column, mod: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % mod


def drawn(rows: DataFrame, ids: list[str], most: int, seed: int, total: int | None = None) -> DataFrame:
    """The `most` rows of least hash of `ids`; a first cut by hash leaves about twice as many, so no task sorts more."""
    h = F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 30))
    share = min(1.0, 2 * most / max(1, rows.count() if total is None else total))
    return rows.where(h < int(share * (1 << 30)) + 1).orderBy(h, *ids).limit(most)


def partitions_for(total: float, each: float, least: int = 1) -> int:
    return max(least, int(-(-total // each)))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def unit_interval(h: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from 64-bit hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POW, _INV = _powers(_BASE, 1 << 16), _powers(pow(_BASE, -1, 1 << 64), 1 << 16)
_POW_HI, _INV_HI = _powers(pow(_BASE, 1 << 16, 1 << 64), 1 << 15), _powers(pow(_BASE, -(1 << 16), 1 << 64), 1 << 15)


def _pow_at(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo[at & 0xFFFF] * hi[at >> 16]


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts end to end and the n+1 offsets; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, off - off[0] if len(off) else np.zeros(1, np.int64)


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of bytes that are not in `space`, and how many runs lie before each document (n+1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over random byte values, by prefix sums, then mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    if len(data) >= 1 << 31:
        raise ValueError("an Arrow batch of 2 GB or more; lower spark.sql.execution.arrow.maxBytesPerBatch")
    total = np.zeros((blocks := -(-len(data) // len(_POW))) * len(_POW) + 1, np.uint64)
    np.take(_BYTE, data, out=total[1 : len(data) + 1])
    grid = total[1:].reshape(blocks, len(_POW))
    grid *= _POW
    grid *= _POW_HI[:blocks, None]
    np.cumsum(total[1:], out=total[1:])
    return mix64((total[end] - total[start]) * _pow_at(start, _INV, _INV_HI) + (end - start).astype(np.uint64))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of their first place, those places, and the number of each element's value."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pa.array(hashes.view(np.int64)).dictionary_encode()
    which = coded.indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=np.int32(-1)))
    return hashes[first], first, which


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i]+1, ... for length[i] steps, end to end."""
    total = int(length.sum())
    out = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) if len(length) else np.zeros(0, np.int64)
    return out + np.arange(total)


def released() -> None:
    """Give memory that earlier batches used back to the system; a reused worker would keep it for the rest of the job."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def batches(frame_batches, rows: int = BATCH_ROWS, size: int = BATCH_BYTES):
    """The incoming Arrow batches, cut again where a batch holds more than `size` bytes."""
    released()
    for b in frame_batches:
        step = max(1, min(rows, int(rows * size / max(1, b.nbytes)))) if b.nbytes > size else max(1, b.num_rows)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    released()
