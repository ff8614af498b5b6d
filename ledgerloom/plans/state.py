"""Queries on state that outlives a run: vendor history, result cache, repeated extraction, and the learned language model."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from ..operators import language as LG
from ..operators import retry as RE
from ..registry import query
from ..sources import cache as C
from ..sources.folders import shared
from ..sources.tables import Tables
from ..streaming import history as H


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_custkey AS vendor_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS total FROM orders),
h AS (SELECT *, count(total) OVER w AS n, avg(total) OVER w AS mean, stddev_samp(total) OVER w AS sd FROM o WINDOW w AS (PARTITION BY vendor_id ORDER BY day, doc_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
d AS (SELECT n.doc_id, min(p.doc_id) AS duplicate_of FROM o n JOIN o p ON p.vendor_id = n.vendor_id AND (p.day, p.doc_id) < (n.day, n.doc_id) AND p.day >= n.day - 30 AND abs(p.total - n.total) < 0.01 WHERE n.total <> 0 AND p.total <> 0 GROUP BY n.doc_id)
SELECT h.doc_id, vendor_id, duplicate_of, CAST(n AS INT) AS n, round(mean + 1e-6, 2) AS mean, coalesce(n >= 5 AND sd > 0 AND total > mean + 3 * sd, false) AS anomalous FROM h LEFT JOIN d ON d.doc_id = h.doc_id""")
def stream_history(spark, d):
    """All orders in four deliveries by date, each checked against the history and appended to it; the stream starts anew from
    its checkpoint for each delivery."""
    folder = f"{shared(spark)}/history-{uuid.uuid4().hex}"
    orders = Tables(spark, d).orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("vendor_id"), F.col("o_orderdate").cast("date").alias("invoice_date"), F.col("o_totalprice").alias("total"))
    year = F.year("invoice_date")
    for part in (year <= 1996, year.isin(1997, 1998), year.isin(1999, 2000), year > 2000):
        orders.where(part).write.mode("append").parquet(f"{folder}/orders")
        out = H.run_over(spark.readStream.schema(orders.schema).parquet(f"{folder}/orders"), folder)
    return out.withColumn("mean", F.round(F.col("mean") + 1e-6, 2))


#: What the stand-in for a model makes of a key, in Spark and in SQL.
_KEY = "left(sha256(text), 16)"


@query(f"""WITH k AS (SELECT doc_id, lang, {_KEY} AS key FROM documents), first AS (SELECT DISTINCT key FROM k WHERE lang <> 'fr'),
runs AS (SELECT 1 AS run, doc_id, key, false AS hit FROM k WHERE lang <> 'fr' UNION ALL SELECT 2, doc_id, key, key IN (SELECT key FROM first) FROM k UNION ALL SELECT 3, doc_id, key, true FROM k UNION ALL SELECT 4, doc_id, key, key NOT IN (SELECT key FROM first) FROM k)
SELECT run, count(*) AS documents, count(*) FILTER (hit) AS hits, count(DISTINCT key) FILTER (NOT hit) AS calls, bit_xor(DISTINCT CAST(concat('0x', left(md5(concat(key, upper(key))), 15)) AS BIGINT)) AS results FROM runs GROUP BY run""")
def result_cache_runs(spark, d):
    """Four runs through one cache: all languages but French, all documents, all again an hour later, and all once the
    entries of the first run have expired. The model is called for keys that the cache lacks, once each."""
    cache = C.ResultCache(spark, f"{shared(spark)}/cache-{uuid.uuid4().hex}", buckets=16)
    docs = Tables(spark, d).documents.select("doc_id", "lang", F.left(F.sha2("text", 256), F.lit(16)).alias("doc_key"))
    out = None
    for run, (rows, now) in enumerate([(docs.where("lang <> 'fr'"), "2024-01-01 00:00:00"), (docs, "2024-01-01 12:00:00"), (docs, "2024-01-01 13:00:00"), (docs, "2024-01-02 06:00:00")], 1):
        got = C.through(cache, rows, "doc_key", lambda keys: keys.withColumn("result", F.upper("key")), now)
        both = F.concat("doc_key", "result")
        one = got.groupBy("doc_key", "result", "hit").agg(F.count(F.lit(1)).alias("n")).agg(
            F.sum("n").alias("documents"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("hits"), F.count_if(~F.col("hit")).alias("calls"), F.bit_xor(F.conv(F.left(F.md5(both), F.lit(15)), 16, 10).cast("long")).alias("results")
        )
        row = spark.createDataFrame([(run, *one.first())], "run int, documents long, hits long, calls long, results long")  # one row a run
        out = row if out is None else out.union(row)
    return out


class Corrector:
    """A stand-in whose answer mends one or two of a page's errors, by the prompt's hash."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"mended": 1 if hashlib.sha256(p.encode()).hexdigest() < "8" else 2}) for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError


@query(f"""WITH RECURSIVE e AS (SELECT doc_id, length(text) - length(regexp_replace(text, '[#$%&*|]', '', 'g')) AS errors FROM documents),
r AS (SELECT doc_id, 0 AS rounds, errors FROM e UNION ALL
  SELECT doc_id, rounds + 1, greatest(0, errors - CASE WHEN sha256(concat('{RE.PROMPT}', 'document ', doc_id, ' has ', errors, ' odd characters')) < '8' THEN 1 ELSE 2 END) FROM r WHERE rounds < 2 AND greatest(0.0, 1.0 - 0.15 * errors) < 0.7)
SELECT doc_id, CAST(max(rounds) AS INT) AS rounds, round(greatest(0.0, 1.0 - 0.15 * arg_max(errors, rounds)), 3) AS confidence FROM r GROUP BY doc_id""")
def re_extraction(spark, d):
    """Documents with odd characters are read again, twice at most; each call mends one or two of them."""
    text = F.col("text")
    docs = Tables(spark, d).documents.select("doc_id", (F.length(text) - F.length(F.regexp_replace(text, r"[#$%&*|]", ""))).alias("errors_then"), F.lit(0).alias("mended_then"))

    def score(pages):
        mended = F.col("mended_then") + F.coalesce(F.get_json_object("answer", "$.mended").cast("int"), F.lit(0))
        left = F.greatest(F.lit(0), F.col("errors_then") - mended)
        hint = F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" has "), left.cast("string"), F.lit(" odd characters"))
        return pages.withColumns({"confidence": F.round(F.greatest(F.lit(0.0), 1.0 - 0.15 * left), 3), "hint": hint, "mended_then": mended})

    return RE.again(docs, Corrector(), score).select("doc_id", "rounds", F.col("confidence"))


@query(f"""WITH t AS (SELECT doc_id, lang, lower(text) AS low, doc_id % 5 = 0 AS held_out FROM documents),
g AS (SELECT doc_id, lang, held_out, unnest([(o[i] * {LG.FIRST} + o[i + 1] * {LG.SECOND} + o[i + 2]) % {LG.CELLS} FOR i IN range(1, len(o) - 1)]) AS cell FROM (SELECT *, [ord(x) FOR x IN string_split(low, '')] AS o FROM t)),
n AS (SELECT lang, cell, count(*) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, cell), s AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
c AS (SELECT doc_id, cell, count(*) AS k FROM g GROUP BY doc_id, cell),
p AS (SELECT doc_id, s.lang, sum(k * ln((coalesce(n, 0) + 1) / CAST(total + {LG.CELLS} AS DOUBLE))) AS score FROM c CROSS JOIN s LEFT JOIN n ON n.lang = s.lang AND n.cell = c.cell GROUP BY doc_id, s.lang),
b AS (SELECT doc_id, arg_max(lang, score) AS best FROM p GROUP BY doc_id)
SELECT t.doc_id, t.lang, held_out, CASE WHEN length(trim(coalesce(low, ''))) >= {LG.SHORT} THEN coalesce(best, '{LG.DEFAULT}') ELSE '{LG.DEFAULT}' END AS language FROM t LEFT JOIN b USING (doc_id)""")
def language_model(spark, d):
    """The language of every document by trigrams learned from four fifths of them."""
    docs = Tables(spark, d).documents.select("doc_id", "lang", "text", (F.col("doc_id") % 5 == 0).alias("held_out"))
    return LG.detected(docs, LG.learned(docs.where("not held_out"))).select("doc_id", "lang", "held_out", "language")
