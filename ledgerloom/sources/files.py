"""Files as tables: listing and hashing, text pages, annotations, corrections, decoded text. All are lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Largest file and suffixes that are taken.
LARGEST, TEXT_SUFFIXES, IMAGE_SUFFIXES = 100 << 20, ("txt", "md"), ("png", "jpg", "jpeg", "tif", "tiff")
ANNOTATION = "text string, left int, top int, width int, height int, label string"


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are that, else Latin-1 (which reads every byte)."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, suffix, length, modified, hash, kind and why a file is refused (null: it is taken)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin(*TEXT_SUFFIXES), "text").when(suffix.isin(*IMAGE_SUFFIXES), "image").when(suffix == "pdf", "pdf")
    refused = F.when(F.col("length") > LARGEST, "too large").when(kind.isNull(), "unsupported suffix")
    return files.select("path", suffix.alias("suffix"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), kind.alias("kind"), refused.alias("refused"), "content")


def text_documents(files: DataFrame) -> DataFrame:
    """doc_id (the path) and text of the text files that are taken."""
    return files.where("refused is null and kind = 'text'").select(F.col("path").alias("doc_id"), "hash", decoded(F.col("content")).alias("text"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated word boxes with a header: doc, pos, text, label (O where missing), box as left, top, right, bottom."""
    rows = spark.read.csv(path, header=True, schema=ANNOTATION, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).select("*", F.input_file_name().alias("doc"))
    pos = F.row_number().over(W.partitionBy("doc").orderBy(F.monotonically_increasing_id()))
    box = F.array("left", "top", F.col("left") + F.col("width"), F.col("top") + F.col("height"))
    return rows.where("text is not null").select("doc", pos.alias("pos"), F.trim("text").alias("text"), F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("O")).alias("label"), box.alias("box"))


def label_lists(words: DataFrame) -> DataFrame:
    """For each document and label but O the words and boxes in order."""
    return words.where("label <> 'O'").groupBy("doc", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "box"))).alias("found"))


def corrections(spark: SparkSession, path: str, doc_type: str, most: int = 5) -> DataFrame:
    """The first messages of a JSON list that hold for a document type or for all."""
    rows = spark.read.json(path, multiLine=True, schema="document_type string, correction string, message string")
    fits = F.coalesce(F.nullif("document_type", F.lit("")), F.lit(doc_type)) == doc_type
    return rows.where(fits).select(F.coalesce(F.nullif("correction", F.lit("")), "message").alias("message")).where("message is not null").limit(most)


def apply_corrections(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """fields (doc_id, page, field, value) with changes (doc_id, key, value); a key `p2__TOTAL` holds for page 2 alone and wins."""
    key = changes.select("doc_id", F.nullif(F.regexp_extract("key", r"^p(\d+)__", 1), F.lit("")).try_cast("int").alias("p"), F.regexp_replace("key", r"^p\d+__", "").alias("field"), F.col("value").alias("new"))
    one = key.where("p is not null").select("doc_id", F.col("p").alias("page"), "field", F.col("new").alias("one"))
    every = key.where("p is null").select("doc_id", "field", F.col("new").alias("every"))
    return fields.join(one, ["doc_id", "page", "field"], "left").join(every, ["doc_id", "field"], "left").select("doc_id", "page", "field", F.coalesce("one", "every", "value").alias("value"), F.coalesce("one", "every").isNotNull().alias("corrected"))
