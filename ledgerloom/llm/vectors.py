"""Shared by the operators on embeddings: which vectors take part, and blocks of rows that share a key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """True for arrays with components, all of them finite numbers, not all zero."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & good & F.exists(vec, lambda x: x != 0), F.lit(False))


def rows_of(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """A matrix of the list column's values, in double precision."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), width or (len(flat) // len(lists) if len(lists) else 1))


def blocked(rows: DataFrame, keys: list[str], id_col: str, most: int) -> DataFrame:
    """Rows whose `keys` others share, dealt to pairs of blocks of about `most` rows: columns bi <= bj, mine.

    A key of at most `most` rows is one block; a larger one is split by a hash of the id into blocks, and every pair
    of blocks meets once. Keys that occur once are left out.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(counts, keys).withColumn("blocks", F.ceil(F.col("n") / most).cast("int")).drop("n")
    met = met.withColumn("mine", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"bi": F.least("mine", "other"), "bj": F.greatest("mine", "other")}).drop("blocks", "other")


def runs(incoming, keys: int):
    """Arrow tables that hold whole groups of equal first `keys` columns; the rows must come sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in incoming:
        if not b.num_rows:
            continue
        ends = group_starts(b, keys)
        last = int(ends[-1])
        if held and not _same(held[-1], b, keys):
            yield pa.Table.from_batches(held)
            held = []
        if last > 0:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: int) -> bool:
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in range(keys))


def group_starts(t, keys: int) -> np.ndarray:
    """Row numbers at which a new group of equal first `keys` columns begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        col = t.column(k)
        v = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def pairs_in(starts: np.ndarray, total: int, at_once: int = 1 << 20):
    """Index pairs i < j within each group, in pieces of about `at_once` pairs."""
    sizes = np.diff(np.append(starts, total))
    row_end = np.repeat(starts + sizes, sizes)
    each = row_end - np.arange(total) - 1
    done = np.cumsum(each)
    a = 0
    while a < total:
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + at_once, side="right")))
        n = each[a:b]
        i = np.repeat(np.arange(a, b), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        if len(i):
            yield i, j
        a = b


def forest(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest id it is linked with, over any number of links i-j."""
    low = ids.copy()
    while len(i):
        m = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        if (before == low).all():
            break
    return low
