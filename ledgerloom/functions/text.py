"""Text normal forms, similarities and checks as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import SIGNS, without

#: Accented letters and what remains of them.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def fold(c: Column) -> Column:
    """Without accents, other letters outside ASCII dropped, trimmed, small, without currency signs."""
    return F.lower(F.trim(F.regexp_replace(without(F.translate(c, ACCENTED, PLAIN), SIGNS), r"[^\x00-\x7F]", "")))


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` names it, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(c: Column) -> Column:
    """Words between spaces, without empty ones; a no-break space counts as a space."""
    return F.filter(F.split(F.translate(c, "  \t\n\r", "     "), " "), lambda w: w != "")


def normal_token(c: Column) -> Column:
    c = F.replace(c, F.lit(","), F.lit("."))
    return F.when(F.contains(c, F.lit(".")), F.rtrim(F.rtrim(c, F.lit("0")), F.lit("."))).otherwise(c)


def token_f1(a: Column, b: Column) -> Column:
    """Of single words 1 - edit distance / length; else common distinct words against both lists' lengths."""
    x, y = fold(a), fold(b)
    xs, ys = (F.filter(F.transform(tokens(t), normal_token), lambda w: w != "") for t in (x, y))
    n, m, both = F.size(xs), F.size(ys), F.size(F.array_intersect(xs, ys))
    one = F.round(1 - F.levenshtein(F.get(xs, F.lit(0)), F.get(ys, F.lit(0))) / F.greatest(F.length(F.get(xs, F.lit(0))), F.length(F.get(ys, F.lit(0)))), 3)
    return F.when((n == 0) | (m == 0), F.when(x == y, 1.0).otherwise(0.0)).when((n == 1) & (m == 1), one).otherwise(2.0 * both / (n + m))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct words; 0 where there are none."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def iban_ok(c: Column) -> Column:
    """Shape of an IBAN, and remainder 1 modulo 97 with letters as 10 to 35 after moving four characters back."""
    c = F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))
    value = lambda d: F.when(F.ascii(d) >= 65, F.ascii(d) - 55).otherwise(F.ascii(d) - 48)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, d: F.when(d == "", a).otherwise((a * F.when(value(d) > 9, 100).otherwise(10) + value(d)) % 97))
    return F.coalesce(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}$") & (rest == 1), F.lit(False))


def first_date(c: Column, formats: list[str]) -> Column:
    """The first format that reads the whole text."""
    return F.coalesce(*[F.try_to_date(c, f) if hasattr(F, "try_to_date") else F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


#: Day-first order in which dates are tried.
DAY_FIRST = ["d/M/yyyy", "yyyy-M-d", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy"]


def strip_markdown(c: Column) -> Column:
    """Blank and separator lines dropped; bars taken out of table rows."""
    lines = F.filter(F.split(c, "\n"), lambda s: (F.trim(s) != "") & ~F.trim(s).rlike(r"^[|:\s-]*-[|:\s-]*$"))
    return F.array_join(F.transform(lines, lambda s: F.when(F.trim(s).startswith("|"), F.trim(F.replace(s, F.lit("|"), F.lit("")))).otherwise(F.trim(s))), "\n")


def count_contained(c: Column, words: list[str]) -> Column:
    """How many of the words occur in the text as substrings: one compiled sum, which evaluates the text once."""
    total = F.lit(0)
    for w in words:
        total += F.when(F.contains(c, F.lit(w)), 1).otherwise(0)
    return total


def repaired_json(c: Column) -> Column:
    """A variant from the text, else from what lies between its first and last brace, else null."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)))


def plain_words(c: Column) -> Column:
    """Small letters without accents and punctuation; letters of other scripts stay."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"(?U)[^\w\s]", "")


def light(c: Column) -> Column:
    """Trimmed, small, a comma as a point, without currency signs."""
    return without(F.replace(F.lower(F.trim(c)), F.lit(","), F.lit(".")), SIGNS)


def overlap_f1(value: Column, source: Column) -> Column:
    """1 if the source has all words of the value, else the F1 of the distinct words of both; 0 where one has none."""
    x, y = (F.array_distinct(tokens(fold(c))) for c in (value, source))
    n, m, both = F.size(x), F.size(y), F.size(F.array_intersect(x, y))
    f1 = F.round(2.0 * both / (n + m) + 1e-12, 3)
    return F.when((n <= 0) | (m <= 0), 0.0).when(both == n, 1.0).otherwise(f1)


#: Texts that stand for no value, patterns of formats by field, and of dates.
PLACEHOLDERS = ["n/a", "null", "none", "unknown", "not found"]
_AMOUNT = [r"[0-9,]+\.?[0-9]*", r"€[0-9,]+", r"\$[0-9,]+"]
FORMATS = {
    "NUMBER": [r"FACTU[/0-9]+", r"INV[-0-9]+", r"FA[-0-9]+", r"[0-9]{4,}"],
    "INVOICE_DATE": [r"[0-9]{2}/[0-9]{2}/[0-9]{4}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"],
    "TOTAL_AMOUNT": _AMOUNT, "TOTAL_UNTAXED": _AMOUNT, "TAX_AMOUNT": _AMOUNT, "LINE/QUANTITY": [r"[0-9]+\.?[0-9]*"], "LINE/UNIT_PRICE": _AMOUNT, "LINE/SUB_TOTAL": _AMOUNT,
}
_MONTHS = "(January|February|March|April|May|June|July|August|September|October|November|December)"
DATES = [r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}", rf"{_MONTHS}\s+[0-9]{{1,2}},?\s+[0-9]{{4}}", rf"[0-9]{{1,2}}\s+{_MONTHS}\s+[0-9]{{4}}"]
#: Identifiers that a text may hold, by kind.
IDENTIFIERS = {"Invoice Number": [r"\b(FA[0-9]{2}/[0-9]{4}/[0-9]+)\b", r"\b(INV[-_]?[0-9]+)\b"], "Reference": [r"\b(BC[0-9]+)\b", r"\b(PO[-_]?[0-9]+)\b"]}


def value_quality(c: Column) -> Column:
    """`empty`, `high` (3 to 499 characters and no placeholder), else `medium`."""
    v = F.trim(c)
    return F.when(c.isNull() | (v == ""), "empty").when((F.length(v) > 2) & (F.length(v) < 500) & ~F.lower(v).isin(*PLACEHOLDERS), "high").otherwise("medium")


def format_score(field: Column, value: Column) -> Column:
    """1 if a pattern of the field is found, 0.3 if none, 0.5 for a field without patterns, 0 for an empty value."""
    out = F.when(value.isNull() | (F.trim(value) == ""), 0.0)
    for name, patterns in FORMATS.items():
        out = out.when(field == name, F.when(value.rlike("(?i)" + "|".join(patterns)), 1.0).otherwise(0.3))
    return out.otherwise(0.5)


def like_a_date(c: Column) -> Column:
    return c.rlike("|".join(DATES))


def has_separator(c: Column) -> Column:
    """Whether a date has a slash, a dash or a point in it."""
    return c.rlike(r"[/.-]")


def missing_identifiers(source: Column, known: Column) -> Column:
    """Lines `- kind: identifier` of those that the source holds and `known` doesn't, in the order of kinds and places."""
    def of(kind: str, pattern: str) -> Column:
        matches = F.regexp_extract_all(source, F.lit("(?i)" + pattern), F.lit(1))
        return F.transform(F.filter(matches, lambda m: ~F.contains(known, m)), lambda m: F.concat(F.lit(f"- {kind}: "), m))

    return F.array_join(F.concat(*[of(kind, p) for kind, ps in IDENTIFIERS.items() for p in ps]), "\n")
