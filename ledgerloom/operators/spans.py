"""Where a field's value stands among the words of a page: a chain of ever looser matches, in the row of the page.

Each link is a fold or a transform over the page's array of words, so a page is gathered once and stays in the JVM. Links of
`span`, each tried where those before found nothing: the value as a piece of the joined text, aligned to whole words; for a
value of one word, an equal word, marks around it aside; for several words, the longest run that begins like the value, marks
and plural endings aside, if it has at least half of its words; the digits of the value within the digits of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, tokens
from .layout import PAGE

#: Marks that don't count around a word, the ending that doesn't count in a run, and what means no value.
MARKS, PLURAL, NOTHING = ".,:;€$£()[]\"'", "s", "null"


def _bare(word: Column) -> Column:
    return F.btrim(word, F.lit(MARKS))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{Nd}", "")


def _none() -> Column:
    return F.array().cast("array<int>")


def _as_text(page: Column, goal: Column) -> Column:
    """Words that lie whole within the first place of `goal` in the joined text."""

    def step(s, size):
        end = s["at"] + size + 1
        inside = (s["at"] >= s["from"]) & (end <= s["to"])
        return F.struct(
            end.alias("at"), (s["i"] + 1).alias("i"), s["from"].alias("from"), s["to"].alias("to"),
            F.when(inside & (s["a"] < 0), s["i"]).otherwise(s["a"]).alias("a"), F.when(inside, s["i"]).otherwise(s["b"]).alias("b"),
        )

    begin = F.instr(page["text"], goal) - 1
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), begin.alias("from"), (begin + F.length(goal) + 1).alias("to"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    found = F.aggregate(page["sizes"], zero, step)
    return F.when(begin >= 0, let(found, lambda s: F.when(s["a"] >= 0, F.sequence(s["a"], s["b"])).otherwise(_none()))).otherwise(_none())


def _as_word(page: Column, word: Column) -> Column:
    alike = lambda w: (w == word) | (_bare(w) == _bare(word))
    at = F.array_position(F.transform(page["low"], alike), F.lit(True)).cast("int")
    return F.when(at > 0, F.array(at - 1)).otherwise(_none())


def _as_run(page: Column, parts: Column) -> Column:
    """The longest run of words that equals the first words of the value, the earliest of equally long ones."""

    def length(words, goal, start):
        def step(s, part):
            word = F.get(words, start + s["n"])
            same = s["on"] & (word.isNotNull() & ((word == part) | (F.rtrim(word, F.lit(PLURAL)) == F.rtrim(part, F.lit(PLURAL)))))
            return F.struct((s["n"] + same.cast("int")).alias("n"), same.alias("on"))

        return F.aggregate(goal, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step)["n"]

    def best(e):
        runs = F.transform(e["words"], lambda _, i: F.struct(length(e["words"], e["goal"], i).alias("n"), (-i).alias("at")))
        enough = F.greatest(F.lit(1), F.floor(F.size(e["goal"]) / 2).cast("int"))
        return let(F.array_max(runs), lambda r: F.when(r["n"] >= enough, F.sequence(-r["at"], r["n"] - r["at"] - 1)).otherwise(_none()))

    bare = F.struct(F.transform(page["low"], _bare).alias("words"), F.transform(parts, _bare).alias("goal"))
    return F.coalesce(let(bare, best), _none())


def _as_digits(page: Column, goal: Column) -> Column:
    """Words whose digits lie within the first place of the value's digits; a word's digits are looked for from where those of
    the word before end, and a word without digits moves that place on by its length and one."""

    def step(s, word):
        def moved(e):
            at = F.when(e["d"] != "", F.call_function("locate", e["d"], s["all"], s["at"] + 1) - 1).otherwise(-1)
            return let(at, lambda a: F.struct(
                F.when(e["d"] == "", s["at"] + F.length(word) + 1).when(a >= 0, a + F.length(e["d"])).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"), s["all"].alias("all"), s["from"].alias("from"), s["to"].alias("to"),
                F.when((a >= s["from"]) & (a + F.length(e["d"]) <= s["to"]), F.concat(s["ids"], F.array(s["i"]))).otherwise(s["ids"]).alias("ids"),
            ))

        return let(F.struct(_digits(word).alias("d")), moved)

    def run(e):
        begin = F.instr(e["all"], e["goal"]) - 1
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), e["all"].alias("all"), begin.alias("from"), (begin + F.length(e["goal"])).alias("to"), _none().alias("ids"))
        return F.when((e["goal"] != "") & (begin >= 0), F.aggregate(page["low"], zero, step)["ids"]).otherwise(_none())

    return let(F.struct(_digits(page["text"]).alias("all"), _digits(goal).alias("goal")), run)


def span(page: Column, goal: Column) -> Column:
    """Numbers (from 0) of the words of `page` (see `page_of`) that `goal`, in small letters, stands for; none, if null."""

    def chain(parts):
        single = F.size(parts) == 1
        several = let(_as_run(page, parts), lambda r: F.when(F.size(r) > 0, r).otherwise(_as_digits(page, goal)))
        return let(_as_text(page, goal), lambda t: F.when(F.size(t) > 0, t).when(single, _as_word(page, F.get(parts, F.lit(0)))).otherwise(several))

    return F.when(goal.isNull() | (goal == "") | (F.size(page["low"]) == 0), _none()).otherwise(let(tokens(goal), chain))


def page_of(words: Column) -> Column:
    """What the chain needs of an array of words: small letters, lengths, and the joined text."""
    low = F.transform(words, F.lower)
    return F.struct(low.alias("low"), F.transform(words, F.length).alias("sizes"), F.array_join(low, " ").alias("text"))


def field_span(words: Column, value: Column, evidence: Column) -> Column:
    """(link, ids) of a field: the span of the evidence, else of the value, else all words that equal one of the value's."""
    goal, cited = F.lower(F.trim(value)), F.lower(F.trim(evidence))

    def of(page):
        any_word = let(tokens(goal), lambda ts: F.filter(F.transform(page["low"], lambda w, i: F.when(F.array_contains(ts, w), i)), lambda i: i.isNotNull()))
        said = lambda link, ids: F.struct(F.lit(link).alias("link"), ids.alias("ids"))
        last = let(any_word, lambda w: F.when(F.size(w) > 0, said("word", w)))
        middle = let(span(page, goal), lambda v: F.when(F.size(v) > 0, said("value", v)).otherwise(last))
        return let(span(page, cited), lambda e: F.when(F.size(e) > 0, said("evidence", e)).otherwise(middle))

    return F.when(value.isNotNull() & (F.trim(value) != "") & (value != NOTHING), let(page_of(words), of))


def field_boxes(words: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, page, field, value, link, n, x0, y0, x1, y1 for (doc_id, field, value, evidence) on each page of words
    (doc_id, page, pos, word, x0, y0, x1, y1) that has the field; pages are gathered once and meet their document's fields."""
    page = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "x0", "y0", "x1", "y1"))).alias("ws"))
    return boxed(page.join(fields, "doc_id"))


def boxed(pages: DataFrame) -> DataFrame:
    """The same of pages that carry a field in their row: doc_id, page, ws (word and box, in order), field, value, evidence.
    Nothing is shuffled. A span comes out of a generator, so that the test whether there is one doesn't work it out again."""
    span = field_span(F.col("ws")["word"], F.col("value"), F.col("evidence"))
    met = pages.withColumn("span", F.explode(F.array_compact(F.array(span))))
    boxes = F.transform(F.col("span.ids"), lambda i: F.get(F.col("ws"), i))
    side = lambda name, pick: pick(F.transform("boxes", lambda b: b[name])).alias(name)
    met = met.select(*PAGE, "field", "value", "span.link", F.size("span.ids").alias("n"), boxes.alias("boxes"))
    return met.select(*PAGE, "field", "value", "link", "n", side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max))
