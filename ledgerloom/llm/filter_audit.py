"""What each of five document filters removes in every order of application, by source.

Exact duplicates come from partition refinement: documents are split by length in code points, then by the hash of one
block of text after the other (blocks double in size, so there are few), and whoever is alone in its class leaves at once.
Only the rows of ids, lengths and hashes are shuffled for that. The full texts of the survivors, found at the scan by a
bitmap of their classes of fixed size, are compared in the end, and all ids but the least of a text are marked. A class of
several texts (hashes that collide) is resolved by its texts.

The five conditions then make a mask of 5 bits a document. Documents are counted by part, mask and label; all 120 orders are
worked out on those counts, at most 32 a part, so their number costs no pass over the documents.

Hot groups: counts combine before the shuffle; classes with a large share of the rows are salted (`join_hot`).

Defined cases: a null text is empty, a null source is the empty part; rows of equal id are documents of their own, and the
same text under the same id is no duplicate; a null id neither is nor makes a duplicate and has no label; several labels of
an id count as their greatest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_map, join_hot, prepare, written

#: The filters in the order of their bits: short, repetitive, capital letters, special characters, exact duplicate.
FILTERS = "ABCDE"
#: Code points of the first block; each further one is as long as all before it.
BLOCK = 4096


def _hash(part: Column) -> Column:
    return F.xxhash64(part)


def blocks(text: Column, size: Column, block: int = BLOCK) -> Column:
    """Hashes of the successive blocks of `text`, which has `size` code points; one for an empty text."""
    # block k > 0 begins at block * 2**(k-1); the length of the binary form of (size-1) / block says how many begin before the end
    count = F.when(size <= block, 0).otherwise(F.length(F.bin(F.floor((size - 1) / block).cast("long"))))
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.lit(block).cast("long") * F.pow(F.lit(2), k - 1).cast("long"))
    wide = lambda k: F.when(k == 0, F.lit(block)).otherwise(begin(k))
    return F.transform(F.sequence(F.lit(0), count), lambda k: _hash(F.substr(text, (begin(k) + 1).cast("int"), wide(k).cast("int"))))


def conditions(text: Column) -> list[Column]:
    """Filters A to D: true where a text fails."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    size, letters = F.length(text), F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * (size - letters) > 5 * size, text.rlike("[#$%&*|]")]


def _together(rows: DataFrame) -> DataFrame:
    """The rows whose `key` others share."""
    counts = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return cut(join_hot(rows, counts, ["key"], "doc_id", rows.count()))


def refined(rows: DataFrame) -> DataFrame:
    """(doc_id, key) of the rows of (doc_id, size, blocks) that agree with another in size and in all blocks."""
    live, k, out = _together(rows.withColumn("key", _hash(F.col("size")))), 0, []
    while True:
        out.append(live.where(F.size("blocks") <= k).select("doc_id", "key"))
        more = live.where(F.size("blocks") > k)
        if more.isEmpty():
            break
        live, k = _together(more.withColumn("key", _hash(F.struct("key", F.get("blocks", F.lit(k)))))), k + 1
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def _full_key(size: Column, hashes: Column) -> Column:
    """The class that refinement ends with."""
    return F.aggregate(hashes, _hash(size), lambda key, h: _hash(F.struct(key.alias("key"), h.alias("h"))))


def duplicates(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(doc_id, key) of the rows of (doc_id, text) whose text a smaller id has; `key` tells texts of one id apart."""
    prepare(docs.sparkSession)
    size = F.length("text").cast("long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    sized = texts.select("doc_id", size.alias("size"), blocks(F.col("text"), size, block).alias("blocks"))
    return _duplicates(texts, refined(written(sized)), block)


def _duplicates(texts: DataFrame, alike: DataFrame, block: int) -> DataFrame:
    size = F.length("text").cast("long")
    alike = written(alike)
    sizes = cut(alike.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    keyed = in_map(texts.withColumn("key", _full_key(size, blocks(F.col("text"), size, block))), sizes, "key")
    # copies of a text combine before the shuffle
    same = keyed.groupBy("key", "text").agg(F.min("doc_id").alias("least"))
    classes = cut(same.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("least").alias("least")).join(sizes, "key"))
    out = join_hot(alike, classes.where("kinds = 1").select("key", "least", "n"), ["key"], "doc_id", alike.count()).where("doc_id > least").select("doc_id", "key")
    if not classes.where("kinds > 1").isEmpty():  # hashes that collide: told apart by the texts
        several = keyed.join(classes.where("kinds > 1").select("key"), "key")
        out = out.union(several.join(several.groupBy("key", "text").agg(F.min("doc_id").alias("least")), ["key", "text"]).where("doc_id > least").select("doc_id", "key"))
    return out.distinct()


def roles(spark) -> DataFrame:
    """What each step of each order does with a document of each mask: 32 x 120 x 5 rows, whatever the input."""
    rows = []
    for order in permutations(FILTERS):
        for mask in range(32):
            gone = False
            for step, f in enumerate(order, 1):
                fails = mask >> FILTERS.index(f) & 1
                removed = int(fails and not gone)
                redundant = int(fails and gone)
                gone = gone or bool(fails)
                rows.append((mask, "".join(order), step, int(not gone), removed, redundant, int(mask == 1 << FILTERS.index(f)), 120 // mask.bit_count() if fails else 0))
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, kept int, removed int, redundant int, alone int, firsts int")


def audit(docs: DataFrame, labels: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = prepare(docs.sparkSession)
    text, size = F.col("text"), F.length("text").cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(text))), F.lit(0))
    measured = written(rows.select("doc_id", "part", bits.alias("bits"), size.alias("size"), blocks(text, size, block).alias("blocks")))
    known = measured.where("doc_id is not null")
    copies = _duplicates(rows.select("doc_id", "text").where("doc_id is not null"), refined(known.select("doc_id", "size", "blocks")), block)
    of = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    keyed = measured.select("doc_id", "part", "bits", _full_key(F.col("size"), F.col("blocks")).alias("key"))
    marked = keyed.join(copies.withColumn("again", F.lit(16)), ["doc_id", "key"], "left").join(of, "doc_id", "left")
    counts = cut(marked.groupBy("part", (F.col("bits") + F.coalesce("again", F.lit(0))).cast("int").alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")))
    each = counts.join(F.broadcast(roles(spark)), "mask")
    total = lambda what, by: F.sum(F.col(what) * F.col(by)).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        *(total("n", c).alias(c) for c in ("kept", "removed", "redundant")), total("n", "alone").alias("unique_fails"),
        total("good", "removed").alias("good_lost"), total("toxic", "removed").alias("toxic_lost"), total("n", "firsts").alias("shapley"),
    )
