"""The corpus pipeline: five stages, each one training-data operator on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All stages but the last keep the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import forget, table, written
from ledgerloom.llm.mixing import mixed
from ledgerloom.llm.packing import pack
from ledgerloom.llm.pii import redact
from ledgerloom.llm.prob_minhash import deduplicate
from ledgerloom.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each class of near copies stays."""
    return deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data gives way to marks; n_chars follows the text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents come as often as their source's weight asks for, each at least once."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of full token windows."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", private), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the trained classifier, the trained field or the greedy packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out)
            if k:
                forget(spark, docs)  # the next stage reads only what this one has written
        docs = out
    return docs
