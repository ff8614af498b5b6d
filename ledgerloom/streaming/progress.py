"""Progress events as streams: sessions, rate windows, replay logs, breaker states.

Event time is the message's time; rows later than ten minutes are dropped. Every operator takes a streaming or a batch
DataFrame of (event_id, ts, user_id, event_type, value), so that the batch run is the twin of the stream.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.folders import shared

#: Watermark, idle time that ends a session, failures that open a breaker, seconds until it is tried again.
LATE, IDLE, FAILURES, PAUSE = "10 minutes", "10 minutes", 5, 30


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def sessions(events: DataFrame) -> DataFrame:
    """user_id, start, events, elapsed of each session that ten idle minutes end."""
    g = timed(events).groupBy("user_id", F.session_window("ts", IDLE).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("elapsed")).select("user_id", F.col("w.start").alias("start"), "n", "elapsed")


def rate_windows(events: DataFrame, most: int = 60, every: str = "1 minute") -> DataFrame:
    """Requests of a user in each window, and whether they pass the limit."""
    g = timed(events).groupBy("user_id", F.window("ts", every).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("limited"))


def breaker_states(events: DataFrame) -> DataFrame:
    """Batch twin of the breaker: runs of at least FAILURES consecutive errors of a user, by gaps and islands."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    bad = F.col("event_type") == "error"
    runs = events.withColumn("run", F.sum((~bad).cast("int")).over(w)).where(bad)
    return runs.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("failures"), F.min("event_id").alias("first_event")).where(F.col("failures") >= FAILURES).drop("run")


def breaker_probes(events: DataFrame, failures: int = FAILURES, pause: int = PAUSE) -> DataFrame:
    """The state in which each event finds its user's breaker: `open` after `failures` consecutive errors, `half_open` once
    `pause` seconds passed since the last of them (the event is then a probe), else `closed`."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    bad = F.col("event_type") == "error"
    seconds = F.col("ts").cast("timestamp").cast("double")
    runs = events.withColumn("run", F.sum((~bad).cast("int")).over(w)).withColumn("errors", F.sum(bad.cast("int")).over(W.partitionBy("user_id", "run").orderBy("ts", "event_id")))
    before = F.when(F.lag(bad).over(w), F.lag("errors").over(w)).otherwise(0)
    seen = runs.select("user_id", "event_id", before.alias("before"), (seconds - F.lag(seconds).over(w)).alias("waited"))
    state = F.when(F.coalesce("before", F.lit(0)) < failures, "closed").when(F.col("waited") >= pause, "half_open").otherwise("open")
    return seen.select("user_id", "event_id", state.alias("state"))


def emissions(lengths, least: int = 50):
    """How often a text that grows by these lengths is passed on, at `least` new characters, and the characters left: n, rest."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("rest"))

    def step(s, x):
        total = s["rest"] + x
        return F.struct(F.when(total >= least, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(total >= least, F.lit(0).cast("long")).otherwise(total).alias("rest"))

    return F.aggregate(lengths, zero, step)


def breaker_stream(events: DataFrame, failures: int = FAILURES) -> DataFrame:
    """The breaker as a stateful operator: one row whenever a user's breaker opens or closes.

    A user's events of a micro-batch may come in several frames in any order; all are put in order together, as times, ids and
    whether they are errors (17 bytes an event).
    """

    def step(key, frames, state):
        count, is_open = state.get if state.exists else (0, False)
        out = []
        every = pd.concat([f[["ts", "event_id"]].assign(bad=f["event_type"] == "error") for f in frames]).sort_values(["ts", "event_id"])
        for event, bad in zip(every["event_id"], every["bad"], strict=True):
            count = count + 1 if bad else 0
            now = count >= failures
            if now != is_open:
                out.append((int(key[0]), int(event), "open" if now else "closed"))
            is_open = now
        state.update((count, is_open))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, state string", "count int, is_open boolean", "append", "NoTimeout")


def replayed(spark: SparkSession, path: str, transform, schema: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over all files of a folder once (available now) and return what it wrote."""

    rows = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema or rows.schema)
    one_file = any(f.rstrip("/").endswith(f"/{name}") for f in rows.inputFiles()[:1])  # a stream reads folders
    source = reader.option("pathGlobFilter", name).parquet(folder) if one_file else reader.parquet(path)
    out = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    write = transform(source).writeStream.outputMode(mode).option("checkpointLocation", f"{out}/log").format("parquet").option("path", f"{out}/rows").trigger(availableNow=True)
    write.start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def append_log(spark: SparkSession, source: DataFrame, path: str) -> None:
    """Append a stream of progress messages to a replay log, partitioned by day; batches that come again are written over."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).withColumn("day", F.to_date("ts")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{path}/log")

    source.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
