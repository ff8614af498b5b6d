"""Confidence weights learned from batches of evaluations, in the order of the batches.

Each batch nudges some weights by 0.05 up to a bound or down to one. A nudge is x -> min(high, max(low, x + d)), and two such
in a row are again one, so the fold over all batches is a prefix scan: blocks of `WIDTH` batches are composed, the blocks'
results are scanned in the same way, and every batch gets what its block starts from. No group holds more than `WIDTH` rows,
however many batches a key has. Weights are whole hundredths inside, so the order of composing changes no digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights before any evaluation.
START = {"ocr_conf": 0.4, "evidence_match": 0.4, "format_valid": 0.2, "vlm_error_deduction": 0.3, "vlm_warning_deduction": 0.15, "vlm_format_deduction": 0.2}
#: Least records of a batch that counts, and of each learned weight the nudges (below or above a mean accuracy;
#: up to or down to a bound).
LEAST, STEP = 3, 0.05
NUDGES = {
    "ocr_conf": [("below", 0.5, "up", 0.6), ("above", 0.85, "down", 0.2)],
    "evidence_match": [("below", 0.5, "down", 0.2)],
    "format_valid": [("above", 0.85, "up", 0.4)],
    "vlm_error_deduction": [("below", 0.4, "up", 0.5), ("above", 0.8, "down", 0.1)],
}
WIDTH, FAR = 128, 1_000_000


def _triple(d, low, high) -> Column:
    return F.struct(F.lit(d).cast("int").alias("d"), F.lit(low).cast("int").alias("low"), F.lit(high).cast("int").alias("high"))


def _each(make) -> Column:
    return F.struct(*[make(w).alias(w) for w in NUDGES])


def _within(x: Column, f: Column) -> Column:
    return F.least(f["high"], F.greatest(f["low"], x))


def _then(f: Column, g: Column) -> Column:
    """First f, then g."""
    one = lambda a, b: F.struct((a["d"] + b["d"]).alias("d"), _within(a["low"] + b["d"], b).alias("low"), _within(a["high"] + b["d"], b).alias("high"))
    return _each(lambda w: one(f[w], g[w]))


def _nudge(weight: str) -> Column:
    step, same = round(STEP * 100), _triple(0, -FAR, FAR)
    out = None
    for side, at, way, bound in NUDGES[weight]:
        met = F.col("accuracy") < at if side == "below" else F.col("accuracy") > at
        to = _triple(step, -FAR, round(bound * 100)) if way == "up" else _triple(-step, round(bound * 100), FAR)
        out = F.when(met, to) if out is None else out.when(met, to)
    return F.when(F.col("n") >= LEAST, out.otherwise(same)).otherwise(same)


def _before(steps: DataFrame, last: int, width: int) -> DataFrame:
    """`steps` (key, at, f) with `g`, all that comes before each step of its key, composed."""
    same = _each(lambda w: _triple(0, -FAR, FAR))
    block = F.floor(F.col("at") / width).alias("block")
    blocks = steps.groupBy("key", block).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("fs"))
    if last < width:
        blocks = blocks.withColumn("g", same)
    else:
        whole = blocks.select("key", F.col("block").alias("at"), F.aggregate("fs", same, lambda s, x: _then(s, x["f"])).alias("f"))
        above = _before(whole, last // width, width).select(F.col("key").alias("k"), F.col("at").alias("b"), "g")
        blocks = blocks.join(above, F.col("key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))).drop("k", "b")
    held = F.struct(F.array().cast(f"array<{_type()}>").alias("done"), F.col("g").alias("g"))
    step = lambda s, x: F.struct(F.concat(s["done"], F.array(s["g"])).alias("done"), _then(s["g"], x["f"]).alias("g"))
    every = F.arrays_zip("fs", F.aggregate("fs", held, step, lambda s: s["done"]).alias("gs"))
    return blocks.select("key", F.explode(every).alias("x")).select("key", F.col("x.fs.at").alias("at"), F.col("x.fs.f").alias("f"), F.col("x.gs").alias("g"))


def _type() -> str:
    return "struct<" + ",".join(f"{w}:struct<d:int,low:int,high:int>" for w in NUDGES) + ">"


def calibrated(records: DataFrame, start: dict[str, float] | None = None, width: int = WIDTH) -> DataFrame:
    """key, batch, n, accuracy and the six weights that hold after each batch, for records (key, batch, accuracy).

    Batches are whole numbers and count in their order within a key; `start` are weights to go on from (those of an earlier
    run). Records without an accuracy or a batch do not count; a batch of fewer than three that count changes nothing, but is
    listed (accuracy null if it has none). A null key is a key of its own. No records, no rows.
    """
    begin = START | (start or {})
    batches = records.where("batch is not null").groupBy("key", F.col("batch").cast("long").alias("batch")).agg(F.count("accuracy").alias("n"), F.avg("accuracy").alias("accuracy"))
    first, last = batches.agg(F.min("batch"), F.max("batch")).first()
    if first is None:
        first = last = 0
    steps = batches.select("key", (F.col("batch") - first).alias("at"), _each(_nudge).alias("f"))
    after = _before(steps, last - first, width).select(F.col("key").alias("k"), (F.col("at") + first).alias("b"), _then(F.col("g"), F.col("f")).alias("h"))
    out = batches.join(after, F.col("key").eqNullSafe(F.col("k")) & (F.col("batch") == F.col("b")))
    learned = {w: (_within(F.lit(round(begin[w] * 100)) + F.col("h")[w]["d"], F.col("h")[w]) / 100).alias(w) for w in NUDGES}
    return out.select("key", "batch", "n", "accuracy", *[learned.get(w, F.lit(float(v)).alias(w)) for w, v in begin.items()])


def latest(weights: DataFrame) -> DataFrame:
    """The weights of each key after its last batch."""
    columns = [c for c in weights.columns if c != "key"]
    return weights.groupBy("key").agg(F.max(F.struct(*columns)).alias("x")).select("key", "x.*")
