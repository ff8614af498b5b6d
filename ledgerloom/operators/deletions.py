"""Names that are a few characters apart meet by equal keys, so that not every name has to be compared with every other one.

Let two names have `n` and `m` characters, and `c` in their longest common subsequence. Then deleting `n - c` characters of one
and `m - c` of the other can leave the same text. A name has a key, a hash, for each text that it leaves with at most `most`
characters deleted; names that share one are as similar as its length says, or more, unless hashes collide, which the caller
has to check. The keys grow with the number of names, and with the square of a name's length, so long names have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the longest name that has keys; keys in a task; pairs that are made at once.
LONGEST, KEYS, PAIRS = 40, 1 << 20, 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)


def left_over(chars: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of what names of one length (a row of codes each) leave when 0, 1, ... `most` (2 at most) characters are deleted."""
    rows, n = chars.shape
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]))
    head = np.zeros((rows, n + 1), np.uint64)
    for k in range(n):
        head[:, k + 1] = head[:, k] * BASE + chars[:, k]
    tail = head[:, n:] - head * power[::-1]
    at = np.arange(n)
    i, j = np.triu_indices(n, 1)
    ways = [
        lambda: head[:, n:],
        lambda: head[:, :n] * power[n - 1 - at] + tail[:, 1:],
        lambda: head[:, i] * power[n - 2 - i] + (head[:, j] - head[:, i + 1] * power[j - i - 1]) * power[n - 1 - j] + tail[:, j + 1],
    ]
    return [way() for way in ways[: min(most, n) + 1]]


def keys_of(names: pd.DataFrame, most: int, least: float) -> pd.DataFrame:
    """key, id, tag of names (id, form, low): the tag holds the text's length, how many characters were deleted, and how many
    may be deleted from another name, if the pair is to have a similarity of `low` or more (0: none, it is only found)."""
    size, out = names["form"].str.len().to_numpy(), []
    for n in np.unique(size[(size > 0) & (size <= LONGEST)]):
        mine = names[size == n]
        chars = np.array(mine["form"].tolist(), dtype=f"U{n}").view(np.uint32).reshape(len(mine), n).astype(np.uint64) + np.uint64(1)
        low = mine["low"].to_numpy(dtype=float)  # not a number: the name asks for nothing
        for k, keys in enumerate(left_over(chars * BASE, most)):
            score = 2.0 * (n - k) / (2 * (n - k) + k + np.arange(most + 1))
            if score[0] >= least:
                ask = (score >= low[:, None]).sum(axis=1) if n + most <= LONGEST else np.zeros(len(mine), int)
                tag = int(n - k) << 8 | k << 4 | ask
                ways = keys.shape[1]
                out.append((keys.ravel().view(np.int64), np.repeat(mine["id"].to_numpy(), ways), np.repeat(tag, ways).astype(np.int32)))
    made = map(np.concatenate, zip(*out, strict=True)) if out else (np.empty(0, t) for t in (np.int64, np.int64, np.int32))
    return pd.DataFrame(dict(zip(("key", "id", "tag"), made, strict=True)))


def pairs_of(keys: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """id, other, score: names that ask, with those of smaller ids that share a key and had the fewest characters deleted."""
    key, ids, tag = (keys[c].to_numpy() for c in ("key", "id", "tag"))
    order = np.lexsort((ids, tag >> 8, key))
    key, ids, tag = key[order], ids[order], tag[order]
    same = (key[1:] == key[:-1]) & (tag[1:] >> 8 == tag[:-1] >> 8)
    kept = np.concatenate([[True], ~(same & (ids[1:] == ids[:-1]))])[: len(key)]  # a text may be left in several ways
    new = np.concatenate([[True], ~same])[: len(key)][kept]  # the first row of a text is never a repeated one
    ids, tag = ids[kept], tag[kept]
    first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    size, cut, may = tag >> 8, tag >> 4 & 15, (tag & 15) - 1
    asking = np.flatnonzero(may >= 0)
    for k in range(most + 1):
        there = cut == k
        before, place = np.concatenate([[0], np.cumsum(there)]), np.flatnonzero(there)
        todo = asking[may[asking] >= k]
        begin, n = before[first[todo]], before[todo] - before[first[todo]]
        todo, begin, n = todo[n > 0], begin[n > 0], n[n > 0]
        upto = np.cumsum(n)
        for part in np.split(np.arange(len(todo)), np.flatnonzero(np.diff(upto // PAIRS)) + 1):
            if len(part):
                m = n[part]
                q = np.repeat(todo[part], m)
                other = place[np.repeat(begin[part], m) + np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m)]
                yield pd.DataFrame({"id": ids[q], "other": ids[other], "score": 2.0 * size[q] / (2 * size[q] + cut[q] + k)})
        asking = np.setdiff1d(asking, todo, assume_unique=True)


def shared(names: DataFrame, most: int, least: float) -> DataFrame:
    """id, other, score: pairs of (id, form, low) that may leave the same text with at most `most` characters deleted of either.

    Among them are all pairs of other < id of the highest score of their id, if that is `low` or more and leaves such a text.
    A null `low` asks for nothing, and names of more than `LONGEST` less `most` characters don't ask.
    """
    n = F.length("form")
    ways = F.when(n <= LONGEST, 1 + n + (n * (n - 1) / 2 if most > 1 else 0)).otherwise(0)
    total = names.agg(F.sum(ways).alias("n")).first().n or 0
    keys = names.mapInPandas(lambda frames: (keys_of(f, most, least) for f in frames), "key long, id long, tag int")
    dealt = keys.repartition(int(max(names.sparkSession.sparkContext.defaultParallelism, -(-total // KEYS))), "key")

    def met(frames):
        every = list(frames)
        if every:
            yield from pairs_of(pd.concat(every, ignore_index=True), most)

    return dealt.mapInPandas(met, "id long, other long, score double")
