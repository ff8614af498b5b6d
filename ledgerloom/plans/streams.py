"""Queries on progress events: the batch twins with SQL, and runs of the streams themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables
from ..streaming import progress as P


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS elapsed FROM s GROUP BY user_id, k""")
def progress_sessions(spark, d):
    return P.sessions(Tables(spark, d).events).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("elapsed", 4).alias("elapsed"))


@query("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY user_id, date_trunc('hour', ts)")
def rate_limit_windows(spark, d):
    return P.rate_windows(Tables(spark, d).events, 2, "1 hour").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "limited")


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT user_id, count(*) AS failures, min(event_id) AS first_event FROM r WHERE event_type = 'error' GROUP BY user_id, run HAVING count(*) >= 5""")
def breaker_states(spark, d):
    return P.breaker_states(Tables(spark, d).events)


@query("SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 25 SECOND, false) AS idle FROM events")
def idle_heartbeats(spark, d):
    """Whether more than 25 seconds passed since a user's last message."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(w)
    return Tables(spark, d).events.select("user_id", "event_id", F.lag("event_id").over(w).alias("previous"), F.coalesce(gap > 25, F.lit(False)).alias("idle"))


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER w AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS errors FROM r),
b AS (SELECT *, CASE WHEN lag(event_type) OVER w = 'error' THEN lag(errors) OVER w ELSE 0 END AS before, epoch(ts - lag(ts) OVER w) AS waited FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN coalesce(before, 0) < 2 THEN 'closed' WHEN waited >= 30 THEN 'half_open' ELSE 'open' END AS state FROM b""")
def breaker_probes(spark, d):
    """The state in which each event finds its user's breaker, which opens after two errors here."""
    return P.breaker_probes(Tables(spark, d).events, failures=2)


@query("""WITH c AS (SELECT conv_id, list(CAST(length(text) % 40 AS BIGINT) ORDER BY turn, text) AS xs FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(list_concat([{'n': 0, 'rest': CAST(0 AS BIGINT)}], list_transform(xs, lambda x: {'n': 0, 'rest': x})), lambda s, x: CASE WHEN s.rest + x.rest >= 50 THEN {'n': s.n + 1, 'rest': CAST(0 AS BIGINT)} ELSE {'n': s.n, 'rest': s.rest + x.rest} END) AS r FROM c)
SELECT conv_id, CAST(r.n AS INT) AS n, r.rest AS rest FROM f""")
def partial_output(spark, d):
    """How often a growing answer is passed on, at fifty new characters."""
    g = Tables(spark, d).conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("ts"))
    r = g.select("conv_id", P.emissions(F.transform("ts", lambda t: (F.length(t) % 40).cast("long"))).alias("r"))
    return r.select("conv_id", "r.n", "r.rest")


@query("""WITH w AS (SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, start, n, n > 2 AS limited FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_rate_windows(spark, d):
    """The windows as a stream writes them: all but those that are still open at the end of the input."""
    out = P.replayed(spark, f"{d}/events.parquet", lambda s: P.rate_windows(s, 2, "1 hour"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "limited")


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
e AS (SELECT user_id, event_id, event_type, run, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS errors, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, ts FROM r),
b AS (SELECT *, lag(errors) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e)
SELECT user_id, event_id, 'open' AS state FROM b WHERE event_type = 'error' AND errors = 5 UNION ALL SELECT user_id, event_id, 'closed' FROM b WHERE event_type <> 'error' AND was = 'error' AND before >= 5""")
def stream_breaker(spark, d):
    return P.replayed(spark, f"{d}/events.parquet", P.breaker_stream)
