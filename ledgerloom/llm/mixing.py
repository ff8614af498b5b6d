"""Mixing sources by temperature: weights w_i ~ p_i ** a of token shares p_i, realised as budgeted block permutations.

The exponent a in [0, 1] is found by section of its range: the least a at which no source is repeated more often than
`max_repeats`, and, with `target_entropy`, the a at which the weights have that entropy (the larger of both; an entropy
below that of the token shares themselves can't be reached and raises ValueError, one above that of equal weights is met
by a = 0). A round evaluates all section points in one aggregate over the table of sources, so sources are never collected.

A source's quota is w_i * budget tokens: whole epochs, then a part of one. In each epoch the documents are permuted by
hash: first to blocks of about `BLOCK` tokens in hash order, then within the block. The part epoch takes whole blocks
from running totals of blocks; only the last block is cut, by running totals inside it. Without a budget, the least one
is used at which every document comes at least once, so nothing is left out. Only DataFrame functions are used.

Defined cases: tokens are runs of non-space characters, null texts have none; a null source is a source of its own;
documents without tokens come once an epoch; rows of equal doc_id are documents of their own that get equal places, and
where a part epoch takes only some of them, the first by source and row are taken; an empty table gives no rows; other columns are ignored by `mixture` and kept by `mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, prepare, written

MAX_REPEATS, BLOCK, SECTIONS, ROUNDS, SEED = 1.5, 1_000_000, 32, 5, 17


def _section(good, lo: float = 0.0, hi: float = 1.0) -> float:
    """The least exponent for which `good` holds, where it holds for all larger ones; `good` judges a list at once."""
    for _ in range(ROUNDS):
        points = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
        first = next((i for i, ok in enumerate(good(points)) if ok), SECTIONS)
        lo, hi = points[max(0, first - 1)], points[first]
    return hi


def exponent(shares: DataFrame, max_repeats: float | None, target_entropy: float | None) -> float:
    """The exponent for a table of shares `p` (positive), by the rules above."""
    low, high = shares.agg(F.min("p"), F.max("p")).first()
    if low is None:
        return 1.0
    a = _section(lambda xs: [(high / low) ** (1 - x) <= max_repeats * (1 + 1e-12) for x in xs]) if max_repeats else 0.0
    if target_entropy is not None:

        def reached(xs):
            cols = [c for x in xs for c in (F.sum(F.col("p") ** F.lit(x)), F.sum(F.col("p") ** F.lit(x) * F.log("p") * F.lit(x)))]
            got = shares.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
            return [math.log(got[2 * i]) - got[2 * i + 1] / got[2 * i] for i in range(len(xs))]

        entropy = lambda x: reached([x])[0]
        entropies = lambda xs: [e <= target_entropy for e in reached(xs)]

        if not entropies([1.0])[0] and not math.isclose(least := entropy(1.0), target_entropy, rel_tol=1e-9, abs_tol=1e-9):
            raise ValueError(f"no exponent from 0 to 1 gives an entropy of {target_entropy}; the token shares have {least:.6g}")
        a = max(a, _section(entropies))
    return a


def counted(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))


def weights(rows: DataFrame, *, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """For (source, tokens): source, total, share, weight, quota, whole (epochs), rest (tokens of the part epoch), blocks."""
    sums = cut(rows.groupBy("source").agg(F.sum("tokens").alias("total")))
    everything = sums.agg(F.sum("total")).first()[0] or 0
    shares = sums.where("total > 0").select((F.col("total") / F.lit(float(everything or 1))).alias("p"))
    a = exponent(shares, max_repeats, target_entropy)
    norm, top = shares.agg(F.sum(F.col("p") ** F.lit(a)), F.max(F.col("p") ** F.lit(1 - a))).first()
    norm = norm or 1.0
    # the largest source is drawn once at the least budget that leaves no document out
    tokens = budget if budget is not None else (top or 0.0) * norm * everything
    p = F.col("total") / F.lit(float(everything or 1))
    out = sums.select("source", "total", p.alias("share"), (F.when(p > 0, p ** F.lit(a)).otherwise(0.0) / F.lit(norm)).alias("weight"))
    out = out.withColumn("quota", F.col("weight") * F.lit(float(tokens)))
    out = out.withColumn("whole", F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total") + 1e-9)).otherwise(1).cast("int"))
    return out.withColumns({"rest": F.greatest(F.lit(0.0), F.col("quota") - F.col("whole") * F.col("total")), "blocks": F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK)).cast("long")})


def _place(epoch) -> Column:
    return F.xxhash64(F.lit(SEED), epoch, F.col("doc_id"))


def _block(place, blocks):
    return F.least(F.floor((place / F.lit(2.0**64) + 0.5) * blocks), blocks - 1).cast("long")


def mixture(docs: DataFrame, *, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each drawn copy: doc_id, source, tokens, epoch, block, place (the order within an epoch is block, place)."""
    prepare(docs.sparkSession)
    rows = written(counted(docs, id_col, source_col, text_col))  # the texts are read once
    plan = weights(rows, max_repeats=max_repeats, target_entropy=target_entropy, budget=budget)
    plan = cut(plan.select(F.col("source").alias("s"), "whole", "rest", "blocks"))
    last = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("place", _place(F.col("whole")))
    last = last.withColumn("block", _block(F.col("place"), F.col("blocks")))
    totals = last.where("rest > 0").groupBy("source", "block").agg(F.sum("tokens").alias("in_block"), F.first("rest").alias("rest"))
    running = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("in_block").over(running), F.lit(0)))
    totals = totals.where("before < rest").select(F.col("source").alias("s"), F.col("block").alias("b"), (F.col("rest") - F.col("before")).alias("left"), (F.col("before") + F.col("in_block") <= F.col("rest")).alias("all"))
    part = last.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    inside = W.partitionBy("source", "block").orderBy("place", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, -1)
    edge = part.where("not all").withColumn("ahead", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).where("ahead < left").drop("ahead")
    columns = ["doc_id", "source", "tokens", F.col("whole").alias("epoch"), "block", "place"]
    epochs = last.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).withColumn("place", _place(F.col("epoch")))
    whole = epochs.select("doc_id", "source", "tokens", "epoch", _block(F.col("place"), F.col("blocks")).alias("block"), "place")
    return whole.union(part.where("all").select(*columns)).union(edge.select(*columns))


def _key(doc_id: Column, source: Column) -> Column:
    """Id and source as one string without null, different for different pairs."""
    return F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("n")), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The documents with all their columns, each as often as it is drawn.

    Copies are counted by id and source. Rows that share both are numbered; an epoch that takes only n of them takes the
    first n, so the number of rows always equals that of `mixture`. Where no rows share both, none are numbered.
    """
    key, times, row = fresh(docs, "drawn_key"), fresh(docs, "drawn_times"), fresh(docs, "drawn_row")
    drawn = mixture(docs, id_col=id_col, source_col=source_col, text_col=text_col, **how)
    drawn = drawn.groupBy(_key(F.col("doc_id"), F.col("source")).alias(key), "epoch").agg(F.count(F.lit(1)).alias("n"))
    drawn = drawn.groupBy(key).agg(F.collect_list("n").alias(times))  # one number an epoch
    keyed = docs.withColumn(key, _key(F.col(id_col), F.col(source_col)))
    met = keyed.join(drawn, key)
    if not keyed.groupBy(key).count().where("count > 1").isEmpty():
        met = met.withColumn(row, F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(*docs.columns))))
        met = met.withColumn(times, F.filter(times, lambda n: n >= F.col(row)))
    copies = met.where(F.size(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.size(times))))
    return copies.select(*docs.columns)
