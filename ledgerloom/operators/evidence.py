"""Evidence of values in source texts: which texts hold a word of a value, or the whole of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: values of so many characters or fewer need no evidence.
SHORT = 3


def has_evidence(value: Column, source: Column) -> Column:
    """Whether a word of the value, or the whole value, stands in the text; capitals aside. Null where one is null."""
    v, s = F.lower(value), F.lower(source)
    return F.arrays_overlap(F.split(v, r"\s+"), F.split(s, r"\s+")) | F.contains(s, v)


def without_evidence(fields: DataFrame) -> DataFrame:
    """Rows of (value, source, ...) whose value of more than SHORT characters has no evidence in its source."""
    return fields.where((F.length("value") > SHORT) & ~has_evidence(F.col("value"), F.coalesce("source", F.lit(""))))


#: Words of all values together that may be broadcast.
FEW = 1_000_000


def documents_with_evidence(values: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, found for (item_id, value) and (doc_id, source): documents that share a word with the value or hold it whole.

    Words meet by an equi-join, for which the values' words are sent to every task while they are few (`FEW`), and a
    document's items are gathered within its own task, so that no pair of item and document is shuffled. A whole value of
    three or more words also shares its inner ones, so only shorter values are looked for as substrings.
    """
    v = values.select("item_id", F.lower("value").alias("v")).withColumn("ws", F.split("v", " "))
    s = docs.select("doc_id", F.lower("source").alias("s"))
    asked = v.select("item_id", F.explode(F.array_distinct("ws")).alias("w"))
    held = s.select("doc_id", F.explode(F.array_distinct(F.split("s", " "))).alias("w"))
    few = asked.limit(FEW + 1).count() <= FEW
    met = held.join(F.broadcast(asked) if few else asked, "w").select("item_id", "doc_id")
    short = v.where(F.size("ws") < 3)
    if not short.isEmpty():
        met = met.union(s.join(short, F.contains("s", F.col("v"))).select("item_id", "doc_id"))
    found = met.groupBy("doc_id").agg(F.collect_set("item_id").alias("items")).select(F.explode("items").alias("item_id")).groupBy("item_id").agg(F.count(F.lit(1)).alias("found"))
    return values.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("found", F.lit(0)).alias("found"))
