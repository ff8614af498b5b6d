"""The history of each vendor's invoices as a table that a stream carries on: every invoice is checked against it, then appended.

Each micro-batch writes one table: its own invoices with what was found, and the state that the next batch starts from. State
are the last `LOOKBACK` invoices of each vendor and those that an invoice not before the watermark can still repeat; so a vendor
with any number of invoices holds a fixed number of them and one window of days, and one that the watermark has left behind by
`FORGET` none. Batches are checked by windows and a join, not vendor by vendor; one that runs again writes its table over.

An invoice arrives by its batch, its date, then its id. One that is dated before what its vendor's state has seen, but not
before the watermark, is checked against that state as it stands; those before the watermark are dropped. The watermark is the
latest date of the batches before, less `LATE` days.

Defined cases: null vendors share one run of totals and repeat nothing; a null total takes a place in the run, but is neither
checked nor counted; rows without a date are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rules import DUPLICATE_DAYS, LEAST_HISTORY, LOOKBACK, SIGMAS

#: Days after which a vendor without invoices is forgotten, and days of lateness that the watermark allows.
FORGET, LATE = 3650, 30
ROWS = "doc_id long, vendor_id long, day date, total double"
CHECKED = ["doc_id", "vendor_id", "duplicate_of", "n", "mean", "anomalous"]
#: Width of the bins in which totals meet: more than the difference of repeated ones, so these are in one bin or the next.
BIN = 0.02


def repeats(new: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, duplicate_of: the smallest earlier invoice of the vendor, of the last `DUPLICATE_DAYS` days and with its total.

    `known` holds the new rows too. Invoices of one vendor, total, day and batch count as one, the smallest of them.
    """
    bin_of = F.floor(F.col("total") / BIN)
    rows = new.where("vendor_id is not null and total <> 0 and not isnan(total)").withColumn("bin", bin_of)
    days = known.where("vendor_id is not null and total <> 0 and not isnan(total)").groupBy("vendor_id", "total", "day", "batch").agg(F.min("doc_id").alias("past_doc"))
    past = days.select(F.col("vendor_id"), F.col("total").alias("past_total"), F.col("day").alias("past_day"), F.col("batch").alias("past_batch"), "past_doc", F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("bin"))
    before = (F.col("past_batch") < F.col("batch")) | (F.col("past_day") < F.col("day")) | ((F.col("past_day") == F.col("day")) & (F.col("past_doc") < F.col("doc_id")))
    near = (F.abs(F.col("past_total") - F.col("total")) < 0.01) & (F.col("past_day") >= F.date_sub("day", DUPLICATE_DAYS))
    return rows.join(past, ["vendor_id", "bin"]).where(before & near).groupBy("doc_id").agg(F.min("past_doc").alias("duplicate_of"))


def checked(new: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of state and of a batch, `fresh` for the batch's, with `duplicate_of`, `n`, `mean`, `anomalous`, and of the
    vendor `last`, its latest day, and `late`, whether the row is one of its last `LOOKBACK`."""
    every = state.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
    order = W.partitionBy("vendor_id").orderBy("batch", "day", "doc_id")
    past = order.rowsBetween(-LOOKBACK, -1)
    total = F.when(~F.isnan("total"), F.col("total"))
    seen = every.select("*", F.count(total).over(past).cast("int").alias("n"), F.avg(total).over(past).alias("mean"), F.stddev_samp(total).over(past).alias("spread"), F.lead(F.lit(1), LOOKBACK).over(order).isNull().alias("late"), F.max("day").over(W.partitionBy("vendor_id")).alias("last"))
    odd = (F.col("n") >= LEAST_HISTORY) & (F.col("spread") > 0) & (total > F.col("mean") + SIGMAS * F.col("spread"))
    return seen.withColumn("anomalous", F.coalesce(odd, F.lit(False))).join(repeats(new, every.drop("fresh")), "doc_id", "left").drop("spread")


def batch_folder(folder: str, n: int) -> str:
    return f"{folder}/rows/batch_id={n}"


def put(batch: DataFrame, n: int, folder: str, forget_days: float) -> None:
    """Check batch `n` against the state that batch `n - 1` has left and write its rows and the new state."""
    spark: SparkSession = batch.sparkSession
    rows = batch.selectExpr("doc_id", "vendor_id", "cast(invoice_date as date) as day", "cast(total as double) as total").where("day is not null").withColumn("batch", F.lit(n).cast("long"))
    if n:
        last = spark.read.parquet(batch_folder(folder, n - 1))
        state = last.where("kept").select("doc_id", "vendor_id", "day", "total", "batch")
        latest = last.agg(F.max("latest")).first()[0]
    else:
        state, latest = spark.createDataFrame([], f"{ROWS}, batch long"), None
    if latest is not None:
        rows = rows.where(F.col("day") >= F.date_sub(F.lit(latest), LATE))
    newest = rows.agg(F.max("day")).first()[0]
    now = max((d for d in (latest, newest) if d is not None), default=None)
    mark = F.date_sub(F.lit(now).cast("date"), LATE)
    kept = (F.col("last") >= F.date_sub(mark, int(forget_days))) & (F.col("late") | (F.col("day") >= F.date_sub(mark, DUPLICATE_DAYS)))
    out = checked(rows, state).withColumns({"kept": kept, "latest": F.lit(now).cast("date")})
    out.where("fresh or kept").drop("late", "last").write.mode("overwrite").parquet(batch_folder(folder, n))


def run_over(source: DataFrame, folder: str, forget_days: float = FORGET) -> DataFrame:
    """Check all of the stream (doc_id, vendor_id, invoice_date, total) that was not given to the checkpoint in `folder` before;
    the rows checked so far."""
    write = source.writeStream.foreachBatch(lambda batch, n: put(batch, n, folder, forget_days)).option("checkpointLocation", f"{folder}/log")
    write.trigger(availableNow=True).start().awaitTermination()
    return source.sparkSession.read.parquet(f"{folder}/rows").where("fresh").select(*CHECKED)
