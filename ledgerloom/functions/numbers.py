"""Number strings. The five parsers differ on purpose; see each docstring. All are null-safe Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency signs dropped by the broad and by the narrow parsers.
SIGNS, FEW_SIGNS = "€$£¥₽₩₨₱₿", "€$£"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def guarded(c: Column) -> Column:
    """A double if the trimmed text is a plain number, else null (never an error, no suffixes such as `1d`)."""
    c = F.trim(c)
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def without(c: Column, signs: str) -> Column:
    return F.translate(c, signs, "")


def parse_simple(c: Column) -> Column:
    """Comma is a point, few signs dropped; inner spaces or two points give null."""
    return guarded(without(F.replace(F.trim(c), F.lit(","), F.lit(".")), FEW_SIGNS))


def parse_broad(c: Column) -> Column:
    """All signs and spaces dropped; of two separators the last is the decimal one; a lone comma is decimal."""
    c = F.regexp_replace(without(c, SIGNS), r"\s+", "")
    comma, point = F.instr(F.reverse(c), F.lit(",")), F.instr(F.reverse(c), F.lit("."))
    swap = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return guarded(F.when((comma > 0) & (point > 0), F.when(comma < point, swap).otherwise(F.replace(c, F.lit(","), F.lit("")))).otherwise(F.replace(c, F.lit(","), F.lit("."))))


def parse_careful(c: Column) -> Column:
    """Like parse_broad, but a lone comma is decimal only if it is the only one with at most two digits behind it."""
    c = F.regexp_replace(without(c, SIGNS), r"\s+", "")
    comma, point = F.instr(F.reverse(c), F.lit(",")), F.instr(F.reverse(c), F.lit("."))
    no_comma, swap = F.replace(c, F.lit(","), F.lit("")), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    lone = F.when(c.rlike(r"^[^,]*,[^,]{0,2}$"), F.replace(c, F.lit(","), F.lit("."))).otherwise(no_comma)
    return guarded(F.when((comma > 0) & (point > 0), F.when(comma < point, swap).otherwise(no_comma)).when(comma > 0, lone).otherwise(c))


def parse_plain(c: Column) -> Column:
    """Trimmed, comma is a point."""
    return guarded(F.replace(F.trim(c), F.lit(","), F.lit(".")))


def parse_or_zero(c: Column) -> Column:
    """Spaces, € and $ dropped, comma is a point; 0 where that is no number."""
    return F.coalesce(guarded(F.replace(F.translate(c, " €$", ""), F.lit(","), F.lit("."))), F.lit(0.0))


def normal_number(c: Column) -> Column:
    """Signs and spaces dropped, comma is a point, zeros after a point cut."""
    c = F.replace(F.replace(without(c, SIGNS), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.when(F.contains(c, F.lit(".")), F.rtrim(F.rtrim(c, F.lit("0")), F.lit("."))).otherwise(c)


def export_number(c: Column) -> Column:
    """Two decimals, or 0.00 where the text has other characters than digits, points and commas."""
    value = F.coalesce(F.when(c.rlike(r"^[0-9.,]+$"), guarded(F.replace(c, F.lit(","), F.lit(".")))), F.lit(0.0))
    return F.format_string("%.2f", F.floor(value * 100 + 0.5) / 100)


def is_amount(c: Column) -> Column:
    """Whether the normal form of the text is a number."""
    return F.coalesce(guarded(normal_number(c)).isNotNull(), F.lit(False))


def money(c: Column) -> Column:
    """Comma is a point, € and $ dropped; null where that is no number."""
    return guarded(F.translate(F.replace(c, F.lit(","), F.lit(".")), "€$", ""))
