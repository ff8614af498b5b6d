r"""Chat formatting with Spark expressions only: sort turn structs, merge same-role neighbours, concatenate.

Template: a user block is `[INST] text [/INST]`, an assistant block is `text</s>`, any other role is
`[ROLE]role[:]text[/ROLE]`. Adjacent turns of one role share a block; `[AND]` stands between their texts. Inside texts
and role names `\` becomes `\\`, and every control string gets a `\` after its first character, so control strings in
the output are always the template's; `unescape` reverses it. Assistant texts carry the loss, their end mark doesn't.

Turns are gathered in pieces of `PIECE` turn numbers, each joined to one string, then the pieces of a conversation are
joined: a conversation of very many turns is one long string in the end, but never one long array of structs.

Defined cases: a null text is empty, a null role is the empty role; turns sort by turn (null first), ties by role, then
text; repeated rows are repeated turns; null conv_id is one conversation; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 256
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[:]", "[AND]"]
AND = "[AND]"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _open(role: Column) -> Column:
    return F.when(role == "user", "[INST] ").when(role == "assistant", "").otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[:]")))


def _close(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").otherwise("[/ROLE]")


def _seam(before: Column, after: Column) -> Column:
    """What stands between two turns, of which `before` may be missing."""
    return F.when(before.isNull(), _open(after)).when(before == after, F.lit(AND)).otherwise(F.concat(_close(before), _open(after)))


def _offset(lengths: Column, i: Column) -> Column:
    return F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length in code points of each assistant text)."""
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / PIECE).alias("part"),
        F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    part = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    part = part.withColumn("xs", F.transform("ts", lambda t, i: F.struct(t["role"].alias("role"), F.when(i > 0, _seam(F.get("ts", i - 1)["role"], t["role"])).otherwise("").alias("seam"), escape(t["text"]).alias("text"))))
    part = part.withColumn("ends", F.transform("xs", lambda x: (F.length(x["seam"]) + F.length(x["text"])).cast("long")))
    spans = F.filter(
        F.transform("xs", lambda x, i: F.struct(x["role"].alias("role"), (_offset(F.col("ends"), i + 1) - F.length(x["text"])).alias("start"), F.length(x["text"]).cast("long").alias("length"))),
        lambda s: s["role"] == "assistant",
    )
    part = part.select(
        "conv_id",
        F.struct(
            "part",
            F.get("xs", F.lit(0))["role"].alias("first"),
            F.element_at("xs", -1)["role"].alias("last"),
            F.array_join(F.transform("xs", lambda x: F.concat(x["seam"], x["text"])), "").alias("body"),
            F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("spans"),
        ).alias("p"),
    )
    whole = part.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    whole = whole.withColumn("seams", F.transform("ps", lambda p, i: _seam(F.when(i > 0, F.get("ps", i - 1)["last"]), p["first"])))
    whole = whole.withColumn("lengths", F.transform("ps", lambda p, i: (F.length(F.get("seams", i)) + F.length(p["body"])).cast("long")))
    shift = lambda p, i: _offset(F.col("lengths"), i) + F.length(F.get("seams", i))
    return whole.select(
        "conv_id",
        F.concat(F.array_join(F.transform("ps", lambda p, i: F.concat(F.get("seams", i), p["body"])), ""), _close(F.element_at("ps", -1)["last"])).alias("formatted"),
        F.flatten(F.transform("ps", lambda p, i: F.transform(p["spans"], lambda s: F.struct((s["start"] + shift(p, i)).alias("start"), s["length"].alias("length"))))).alias("loss_spans"),
    )


def read_chats(formatted: Column) -> Column:
    """The turns (array of role, text) that a formatted conversation holds; the inverse of `format_chats`."""
    blocks = F.filter(F.split(formatted, r"(?<=\[/INST\]|</s>|\[/ROLE\])", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        user, mine = b.endswith("[/INST]"), b.endswith("</s>")
        role = F.when(user, "user").when(mine, "assistant").otherwise(unescape(F.substring_index(F.substr(b, F.lit(7)), "[:]", 1)))
        other = F.substr(b, F.instr(b, F.lit("[:]")) + 3, F.length(b) - F.instr(b, F.lit("[:]")) - 9)
        inner = F.when(user, F.substr(b, F.lit(8), F.length(b) - 15)).when(mine, F.substr(b, F.lit(1), F.length(b) - 4)).otherwise(other)
        return F.transform(F.split(inner, r"\[AND\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under a loss mask, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted conversations say: turns read back from the text, loss through the mask."""
    read = formatted.select("conv_id", read_chats(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
