"""Keyword classifiers: a type's score comes from its keywords that a text contains as substrings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import count_contained


def classify_weighted(docs: DataFrame, signatures: dict = L.PAGE_SIGNATURES, extra: float = 0.2, least: float = 0.5) -> DataFrame:
    """type and confidence: top score against the rest of all scores plus one; `other` where that is below `least`.

    All keywords are tested in one projection, so the text never leaves the row and nothing is shuffled.
    """
    low = F.lower("text")
    scored = F.array(*[F.struct((count_contained(low, ws) * (w + extra)).alias("score"), F.lit(-i).alias("ord"), F.lit(k).alias("type")) for i, (k, (w, ws)) in enumerate(signatures.items())])
    s = docs.select("doc_id", "text", scored.alias("s")).withColumn("top", F.array_max("s")).withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["score"]))
    conf = F.least(F.lit(1.0), F.col("top.score") / F.greatest(F.col("total") - F.col("top.score") + 1, F.lit(1.0)))
    none = (F.length(F.trim("text")) < 5) | (F.col("top.score") <= 0)
    return s.select("doc_id", F.when(none | (conf < least), "other").otherwise(F.col("top.type")).alias("type"), F.when(none, 0.5).otherwise(F.round(conf, 3)).alias("confidence"))


def classify_counted(docs: DataFrame, keywords: dict = L.PAGE_KEYWORDS) -> DataFrame:
    """type with most keywords found; confidence is one and a half times its share of all found, at most 0.95."""
    low = F.lower("text")
    scored = F.array(*[F.struct(count_contained(low, ws).alias("score"), F.lit(-i).alias("ord"), F.lit(k).alias("type")) for i, (k, ws) in enumerate(keywords.items())])
    s = docs.select("doc_id", scored.alias("s")).withColumn("top", F.array_max("s")).withColumn("total", F.aggregate("s", F.lit(0), lambda a, x: a + x["score"]))
    some = F.col("total") > 0
    return s.select("doc_id", F.when(some, F.col("top.type")).otherwise("UNKNOWN").alias("type"), F.when(some, F.round(F.least(F.lit(0.95), 1.5 * F.col("top.score") / F.col("total")), 3)).otherwise(0.0).alias("confidence"))


def classify_documents(docs: DataFrame, signatures: dict = L.PAGE_SIGNATURES) -> DataFrame:
    """Like `classify_weighted` for whole documents: more weight a keyword, and `unknown` for texts of under ten characters
    and for those without a clear type."""
    scored = classify_weighted(docs, signatures, extra=0.3)
    short = docs.select("doc_id", (F.length(F.trim("text")) < 10).alias("short"))
    return scored.join(short, "doc_id").select("doc_id", F.when(F.col("short") | (F.col("type") == "other"), "unknown").otherwise(F.col("type")).alias("type"), "confidence")


def document_types(pages: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, type, share, kind: each page is classified, then the type of most pages is the document's; `mixed` where its
    share is below `least`. For (doc_id, page, text)."""
    numbered = pages.select("doc_id", "page", F.struct("doc_id", "page").alias("of"), "text")
    typed = classify_weighted(numbered.select(F.col("of").alias("doc_id"), "text")).select("doc_id.*", "type")
    counts = typed.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("doc_id").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"), (F.max("n") / F.sum("n")).alias("share"))
    return best.withColumn("kind", F.when(F.col("share") < least, "mixed").otherwise("uniform"))
