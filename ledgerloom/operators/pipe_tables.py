"""Pipe tables in texts: runs of three or more `| ... |` lines, of which the first is the header and the second a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import HEADERS
from ..functions.text import let

FIELDS = ["description", "quantity", "uom", "unit_price", "sub_total", "total", "vat_rate"]


def header_field(cell: Column) -> Column:
    """The item field of the first header word that the cell contains."""
    low = F.trim(F.regexp_replace(F.lower(cell), "[_*]", " "))
    return let(low, lambda c: F.coalesce(*[F.when(F.contains(c, F.lit(word)), F.lit(field)) for word, field in HEADERS]))


def cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.split(inner, r"\|", -1)


#: Neighbouring `| ... |` lines (group 1, may be empty) and the line after them, each with the break before it. A break other than
#: \n may stand after the last bar only. Nothing is tried twice, so long tables take no more of the stack.
BLOCK = r"((?:\n *\|.*\|(?:(?!.)[^\n])? *(?=\n|\z))*+)(?:\n[^\n]*)?"


def table_items(docs: DataFrame) -> DataFrame:
    """doc_id, table, row (from 0) and the item fields of each data row; tables without a description column give none.
    Tables are found in the row of their text, so nothing is shuffled, and a header is read once a table."""
    blocks = F.regexp_extract_all(F.concat(F.lit("\n"), "text"), F.lit(BLOCK), F.lit(1))
    found = docs.select("doc_id", F.posexplode(blocks).alias("at", "block")).where("block <> ''")
    tables = found.select("doc_id", (F.col("at") - 1).alias("table"), F.split(F.ltrim("block", F.lit("\n")), "\n").alias("lines")).where("size(lines) >= 3")
    heads = F.transform(cells(F.get("lines", F.lit(0))), header_field)
    tables = tables.select("doc_id", "table", F.explode(F.array(F.struct("lines", heads.alias("heads")))).alias("t")).select("doc_id", "table", "t.*")
    last = lambda field: F.size("heads") - F.nullif(F.array_position(F.reverse("heads"), F.lit(field)), F.lit(0)).cast("int")  # noqa: E731  # the last column of that name counts
    data = F.when(F.array_contains("heads", "description"), F.slice("lines", F.lit(3), F.size("lines") - 2))
    tables = tables.select("doc_id", "table", *[last(f).alias(f) for f in FIELDS], data.alias("data"))
    rows = tables.select("doc_id", "table", *FIELDS, F.posexplode("data").alias("row", "line")).where(F.translate("line", "| ", "") != "")
    rows = rows.withColumn("cells", cells(F.col("line")))

    def value(field: str) -> Column:
        v = F.trim(F.get("cells", F.col(field)))
        return F.when((v != "") & (v != "-"), v).alias(field)

    return rows.select("doc_id", "table", "row", *[value(f) for f in FIELDS])
