"""Queries that hold predictions against ground truth, and quality measures.

Ground truth and predictions are derived from orders and parts: a prediction is null every 7th key, capitals every 5th,
one percent off every 11th.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import evidence as V
from ..registry import query
from ..sources.tables import Tables

_EV = """gt AS (SELECT o_orderkey AS doc_id, 'NUMBER' AS field, CAST(o_orderkey AS VARCHAR) AS truth FROM orders UNION ALL SELECT o_orderkey, 'STATUS', concat('st ', lower(o_orderstatus)) FROM orders
  UNION ALL SELECT o_orderkey, 'TOTAL', CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) FROM orders),
pr AS (SELECT doc_id, field, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN upper(truth) WHEN doc_id % 11 = 0 AND field = 'TOTAL' THEN CAST(CAST(trunc(CAST(truth AS DOUBLE) * 1.01) AS BIGINT) AS VARCHAR) ELSE truth END AS pred FROM gt WHERE doc_id % 13 <> 0 OR field <> 'STATUS'
  UNION ALL SELECT o_orderkey, 'EXTRA', 'x' FROM orders WHERE o_orderkey % 17 = 0)"""


def truth_and_predictions(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("n"), F.concat(F.lit("st "), F.lower("o_orderstatus")).alias("s"), F.col("o_totalprice").cast("long").cast("string").alias("t"))
    gt = o.select("doc_id", F.explode(F.create_map(F.lit("NUMBER"), "n", F.lit("STATUS"), "s", F.lit("TOTAL"), "t")).alias("field", "truth"))
    k = F.col("doc_id")
    pred = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.upper("truth")).when((k % 11 == 0) & (F.col("field") == "TOTAL"), (F.col("truth").try_cast("double") * 1.01).cast("long").cast("string")).otherwise(F.col("truth"))
    pr = gt.where((k % 13 != 0) | (F.col("field") != "STATUS")).select("doc_id", "field", pred.alias("pred"))
    return gt, pr.union(o.where(k % 17 == 0).select("doc_id", F.lit("EXTRA"), F.lit("x")))


JOINED_SQL = f"WITH {_EV}, j AS (SELECT doc_id, field, truth, pred, truth IS NOT NULL AND pred IS NOT NULL AND lower(truth) = lower(pred) AS exact FROM gt FULL JOIN pr USING (doc_id, field))"


def joined(t: Tables):
    gt, pr = truth_and_predictions(t)
    return gt.join(pr, ["doc_id", "field"], "full_outer").withColumn("exact", F.coalesce(F.lower("truth") == F.lower("pred"), F.lit(False)))


@query(f"{JOINED_SQL} SELECT field, count(*) AS n, CAST(sum(CAST(exact AS INT)) AS BIGINT) AS hits, round(avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END), 4) AS score FROM j GROUP BY field")
def accuracy_per_field(spark, d):
    return joined(Tables(spark, d)).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exact").cast("int")).alias("hits"), F.round(F.avg(F.when(F.col("exact"), 1.0).otherwise(0.0)), 4).alias("score"))


@query(f"""{JOINED_SQL}, c AS (SELECT field, CAST(count(*) FILTER (exact) AS DOUBLE) AS tp, CAST(count(*) FILTER (pred IS NOT NULL AND NOT exact) AS DOUBLE) AS fp, CAST(count(*) FILTER (truth IS NOT NULL AND NOT exact) AS DOUBLE) AS fn FROM j GROUP BY field)
SELECT coalesce(field, 'ALL') AS field, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(2 * sum(tp) / greatest(2 * sum(tp) + sum(fp) + sum(fn), 1), 4) AS f1 FROM c GROUP BY ROLLUP (field)""")
def entity_f1_micro(spark, d):
    """Counts and F1 of each field, and of all together, by one rollup."""
    ok, n = F.col("exact"), F.lit(1)
    c = joined(Tables(spark, d)).rollup("field").agg(F.count(F.when(ok, n)).alias("tp"), F.count(F.when(F.col("pred").isNotNull() & ~ok, n)).alias("fp"), F.count(F.when(F.col("truth").isNotNull() & ~ok, n)).alias("fn"))
    return c.select(F.coalesce("field", F.lit("ALL")).alias("field"), "tp", "fp", "fn", F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), n), 4).alias("f1"))


@query(f"""WITH {_EV} SELECT count(*) AS n, round(avg(CASE WHEN p IS NULL THEN NULL ELSE greatest(0.0, 1 - abs(p - g) / g) END), 6) AS closeness FROM (SELECT CAST(truth AS DOUBLE) AS g, CAST(pred AS DOUBLE) AS p FROM gt JOIN pr USING (doc_id, field) WHERE field = 'TOTAL')""")
def numeric_delta(spark, d):
    gt, pr = truth_and_predictions(Tables(spark, d))
    g, p = F.col("truth").try_cast("double"), F.col("pred").try_cast("double")
    return gt.where("field = 'TOTAL'").join(pr, ["doc_id", "field"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(p.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(p - g) / g))), 6).alias("closeness"))


@query(f"WITH {_EV} SELECT field, round(avg(CASE WHEN pred IS NULL THEN 0.0 ELSE 1.0 END), 4) AS rate, count(*) AS n FROM pr GROUP BY field")
def detection_rate(spark, d):
    return truth_and_predictions(Tables(spark, d))[1].groupBy("field").agg(F.round(F.avg(F.when(F.col("pred").isNull(), 0.0).otherwise(1.0)), 4).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT item_id, lower(text) AS val, string_split(lower(text), ' ') AS ws FROM benchmark), s AS (SELECT doc_id, lower(text) AS src, string_split(lower(text), ' ') AS ds FROM documents)
SELECT item_id, (SELECT count(*) FROM documents) AS n, CAST(sum(CASE WHEN contains(src, val) OR list_has_any(ws, ds) THEN 1 ELSE 0 END) AS BIGINT) AS found FROM b, s GROUP BY item_id""")
def faithfulness(spark, d):
    """In how many of all documents a word of a value, or the whole, stands."""
    t = Tables(spark, d)
    found = V.documents_with_evidence(t.benchmark.select("item_id", F.col("text").alias("value")), t.documents.select("doc_id", F.col("text").alias("source")))
    return found.join(F.broadcast(t.documents.agg(F.count(F.lit(1)).alias("n")))).select("item_id", "n", "found")


_TIER = """CASE WHEN val = src THEN 1.0 WHEN contains(src, val) THEN 0.9 WHEN ov > 0.7 THEN 0.8 * ov ELSE 0.0 END"""


@query(f"""WITH t AS (SELECT p_partkey AS id, lower(p_name) AS val, lower(concat(p_type, ' ', CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE reverse(p_name) END)) AS src FROM part), o AS (SELECT *, len(list_intersect(string_split(val, ' '), string_split(src, ' '))) / CAST(len(list_distinct(string_split(val, ' '))) AS DOUBLE) AS ov FROM t)
SELECT id, round(CAST({_TIER} AS DOUBLE), 4) AS score FROM o""")
def faithfulness_tiers(spark, d):
    t = Tables(spark, d).part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("val"), F.lower(F.concat_ws(" ", "p_type", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.reverse("p_name")))).alias("src"))
    a, b = F.split("val", " "), F.split("src", " ")
    ov = F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))
    return t.select("id", F.round(F.when(F.col("val") == F.col("src"), 1.0).when(F.contains("src", F.col("val")), 0.9).when(ov > 0.7, 0.8 * ov).otherwise(0.0), 4).alias("score"))


@query(f"""WITH {_EV} SELECT coalesce(p.field, g.field) AS field, round(avg(CASE WHEN g.field IS NULL THEN 0.3 WHEN pred IS NULL THEN 0.0 WHEN length(pred) > 2 AND length(pred) < 500 THEN 1.0 ELSE 0.7 END), 4) AS relevancy
FROM gt g FULL JOIN pr p ON g.doc_id = p.doc_id AND g.field = p.field GROUP BY 1""")
def answer_relevancy(spark, d):
    score = F.when(F.col("truth").isNull(), 0.3).when(F.col("pred").isNull(), 0.0).when((F.length("pred") > 2) & (F.length("pred") < 500), 1.0).otherwise(0.7)
    return joined(Tables(spark, d)).groupBy("field").agg(F.round(F.avg(score), 4).alias("relevancy"))


@query("""SELECT doc_id, round(0.35 * (doc_id % 10) / 10.0 + 0.25 * least(1.0, n_chars / 5000.0) + 0.2 * CASE WHEN lang = 'en' THEN 1 ELSE 0 END + 0.2 * CASE WHEN contains(text, '.') THEN 1 ELSE 0 END + 1e-9, 4) AS score FROM documents""")
def reasoning_confidence(spark, d):
    """Blend of four signals with the weights 0.35, 0.25, 0.20, 0.20."""
    one = lambda c: F.when(c, 1).otherwise(0)
    s = 0.35 * (F.col("doc_id") % 10) / 10.0 + 0.25 * F.least(F.lit(1.0), F.col("n_chars") / 5000.0) + 0.2 * one(F.col("lang") == "en") + 0.2 * one(F.contains("text", F.lit(".")))
    return Tables(spark, d).documents.select("doc_id", F.round(s + 1e-9, 4).alias("score"))


FLAGS_SQL = """SELECT count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) * 100, 4) AS good_pct, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) * 100, 4) AS toxic_pct,
  CASE WHEN avg(quality) >= 0.8 THEN 'PASS' WHEN avg(quality) < 0.5 THEN 'FAIL' ELSE 'PARTIAL' END AS verdict FROM labels"""


@query(FLAGS_SQL)
def quality_flags(spark, d):
    q = F.avg("quality")
    return Tables(spark, d).labels.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)) * 100, 4).alias("good_pct"), F.round(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)) * 100, 4).alias("toxic_pct"), F.when(q >= 0.8, "PASS").when(q < 0.5, "FAIL").otherwise("PARTIAL").alias("verdict"))


@query("SELECT round(avg(CAST(quality AS DOUBLE)), 6) AS accuracy, CASE WHEN count(*) < 3 THEN 0.4 WHEN avg(quality) < 0.5 THEN 0.45 WHEN avg(quality) > 0.85 THEN 0.35 ELSE 0.4 END AS word_weight FROM labels")
def calibration_mean(spark, d):
    m = F.avg("quality")
    return Tables(spark, d).labels.agg(F.round(m, 6).alias("accuracy"), F.when(F.count(F.lit(1)) < 3, 0.4).when(m < 0.5, 0.45).when(m > 0.85, 0.35).otherwise(0.4).alias("word_weight"))


@query(f"""WITH RECURSIVE r AS (SELECT source AS key, CAST(doc_id // 50 AS BIGINT) AS batch, count(quality) AS n, avg(quality) AS accuracy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY batch) AS i FROM r),
f AS (SELECT key, CAST(-1 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS accuracy, CAST(0 AS BIGINT) AS i, 40 AS a, 40 AS b, 20 AS c, 30 AS e FROM (SELECT DISTINCT key FROM o)
  UNION ALL SELECT o.key, o.batch, o.n, o.accuracy, o.i,
    CASE WHEN o.n >= 3 AND o.accuracy < 0.5 THEN least(60, a + 5) WHEN o.n >= 3 AND o.accuracy > 0.85 THEN greatest(20, a - 5) ELSE a END,
    CASE WHEN o.n >= 3 AND o.accuracy < 0.5 THEN greatest(20, b - 5) ELSE b END, CASE WHEN o.n >= 3 AND o.accuracy > 0.85 THEN least(40, c + 5) ELSE c END,
    CASE WHEN o.n >= 3 AND o.accuracy < 0.4 THEN least(50, e + 5) WHEN o.n >= 3 AND o.accuracy > 0.8 THEN greatest(10, e - 5) ELSE e END
  FROM f JOIN o ON o.key IS NOT DISTINCT FROM f.key AND o.i = f.i + 1)
SELECT key, batch, n, accuracy, a / 100 AS ocr_conf, b / 100 AS evidence_match, c / 100 AS format_valid, e / 100 AS vlm_error_deduction, 0.15 AS vlm_warning_deduction, 0.2 AS vlm_format_deduction FROM f WHERE i > 0""")
def calibration_fold(spark, d):
    """The weights after each batch of documents (fifty numbers), folded by source in the order of the batches."""
    t = Tables(spark, d)
    records = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return C.calibrated(records.select(F.col("source").alias("key"), F.floor(F.col("doc_id") / 50).alias("batch"), F.col("quality").alias("accuracy")))


@query("""SELECT event_type AS step, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(min(value), 4) AS low, round(max(value), 4) AS high FROM events GROUP BY event_type""")
def step_timings(spark, d):
    at = lambda p: F.round(F.percentile("value", F.lit(p)), 4)
    return Tables(spark, d).events.groupBy(F.col("event_type").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"))


@query("""WITH s AS (SELECT user_id, sum(value) AS t FROM events GROUP BY user_id) SELECT count(*) AS docs, round(count(*) / sum(t), 6) AS per_second, round(quantile_cont(t, 0.5), 4) AS p50, round(quantile_cont(t, 0.95), 4) AS p95 FROM s""")
def batch_latency_percentiles(spark, d):
    s = Tables(spark, d).events.groupBy("user_id").agg(F.sum("value").alias("t"))
    return s.agg(F.count(F.lit(1)).alias("docs"), F.round(F.count(F.lit(1)) / F.sum("t"), 6).alias("per_second"), F.round(F.percentile("t", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("t", F.lit(0.95)), 4).alias("p95"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY CUBE (lang, source)")
def dataset_cube(spark, d):
    """Beyond the engine's own queries: all grouping sets of two columns."""
    return Tables(spark, d).documents.cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH f AS (SELECT o_orderkey AS doc_id, c_name AS supplier, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT doc_id, 'TOTAL' AS field, unnest(['a', 'b', 'c']) AS mode, unnest([total, CASE WHEN doc_id % 9 = 0 THEN total * 2 ELSE total END, total]) AS v FROM f)
SELECT doc_id, round(max(v) FILTER (mode = 'a'), 2) AS a, round(max(v) FILTER (mode = 'b'), 2) AS b, round(max(v) FILTER (mode = 'c'), 2) AS c, count(DISTINCT v) > 1 AS differ FROM m GROUP BY doc_id""")
def mode_compare_pivot(spark, d):
    """One field as three modes extract it, side by side."""
    v = F.col("o_totalprice")
    f = Tables(spark, d).orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.create_map(F.lit("a"), v, F.lit("b"), F.when(F.col("o_orderkey") % 9 == 0, v * 2).otherwise(v), F.lit("c"), v)).alias("mode", "v"))
    p = f.groupBy("doc_id").pivot("mode", ["a", "b", "c"]).agg(F.round(F.max("v"), 2))
    return p.withColumn("differ", F.size(F.array_distinct(F.array("a", "b", "c"))) > 1)


_COUNTS = f"""{JOINED_SQL}, c AS (SELECT field, CAST(count(*) FILTER (exact) AS DOUBLE) AS tp, CAST(count(*) FILTER (pred IS NOT NULL AND NOT exact) AS DOUBLE) AS fp, CAST(count(*) FILTER (truth IS NOT NULL AND NOT exact) AS DOUBLE) AS fn FROM j GROUP BY field),
m AS (SELECT field, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, 2 * tp / greatest(2 * tp + fp + fn, 1) AS f1, tp, fp, fn FROM c)"""


def measures(t: Tables):
    """field, tp, fp, fn, p, r, f1."""
    ok, n = F.col("exact"), F.lit(1)
    c = joined(t).groupBy("field").agg(F.count(F.when(ok, n)).alias("tp"), F.count(F.when(F.col("pred").isNotNull() & ~ok, n)).alias("fp"), F.count(F.when(F.col("truth").isNotNull() & ~ok, n)).alias("fn"))
    share = lambda a, b: a / F.greatest(b, n)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"p": share(tp, tp + fp), "r": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


@query(f"{_COUNTS} SELECT field, round(p, 4) AS p, round(r, 4) AS r, round(f1, 4) AS f1 FROM m")
def field_precision_recall(spark, d):
    return measures(Tables(spark, d)).select("field", *[F.round(c, 4).alias(c) for c in ("p", "r", "f1")])


@query(f"{_COUNTS} SELECT round(avg(f1), 4) AS macro_f1, round(2 * sum(tp) / greatest(2 * sum(tp) + sum(fp) + sum(fn), 1), 4) AS micro_f1, avg(f1) > 0.7 AS accurate, (SELECT sum(value) < 5000 FROM events) AS fast, (SELECT max(value) < 2048 FROM events) AS memory_efficient FROM m")
def production_summary(spark, d):
    """Macro and micro F1 over the fields, and flags of accuracy, time and memory."""
    t = Tables(spark, d)
    f = measures(t).agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(2 * F.sum("tp") / F.greatest(2 * F.sum("tp") + F.sum("fp") + F.sum("fn"), F.lit(1)), 4).alias("micro_f1"), (F.avg("f1") > 0.7).alias("accurate"))
    return f.join(t.events.agg((F.sum("value") < 5000).alias("fast"), (F.max("value") < 2048).alias("memory_efficient")))


METRICS = {
    "accuracy": lambda t: joined(t).agg(F.avg(F.col("exact").cast("int")).alias("value")),
    "detection_rate": lambda t: truth_and_predictions(t)[1].agg(F.avg(F.col("pred").isNotNull().cast("int")).alias("value")),
    "validity": lambda t: truth_and_predictions(t)[1].agg(F.avg(F.when(F.length("pred") > 2, 1.0).otherwise(0.5)).alias("value")),
}


@query(f"""{JOINED_SQL} SELECT 'accuracy' AS metric, round(avg(CAST(exact AS INT)), 6) AS value FROM j UNION ALL SELECT 'detection_rate', round(avg(CASE WHEN pred IS NULL THEN 0.0 ELSE 1.0 END), 6) FROM pr UNION ALL SELECT 'validity', round(avg(CASE WHEN length(pred) > 2 THEN 1.0 ELSE 0.5 END), 6) FROM pr""")
def evaluation_metrics(spark, d):
    """The chosen metrics as one table."""
    t, out = Tables(spark, d), None
    for name, metric in METRICS.items():
        row = metric(t).select(F.lit(name).alias("metric"), F.round("value", 6).alias("value"))
        out = row if out is None else out.union(row)
    return out
