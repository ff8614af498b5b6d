"""Queries on batches, reviews, caches, data sets, the step graph and exports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import ERP_COLUMNS
from ..operators import exports as E
from ..operators import steps as S
from ..registry import query
from ..sources.tables import SQL_INVOICES, SQL_ITEMS, Tables


@query("""SELECT event_type AS cache, CAST(sum(CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS lookups, round(avg(CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 1.0 ELSE 0.0 END), 4) AS rate FROM events GROUP BY ROLLUP (event_type)""")
def cache_hit_rates(spark, d):
    hit = F.when(F.floor("value") % 2 == 0, 1)
    return Tables(spark, d).events.rollup(F.col("event_type").alias("cache")).agg(F.count(hit).alias("hits"), F.count(F.lit(1)).alias("lookups"), F.round(F.avg(F.coalesce(hit, F.lit(0)).cast("double")), 4).alias("rate"))


@query("SELECT o_orderpriority AS batch, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS waiting FROM orders GROUP BY o_orderpriority")
def batch_stats(spark, d):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return Tables(spark, d).orders.groupBy(F.col("o_orderpriority").alias("batch")).agg(F.count(F.lit(1)).alias("total"), n("F").alias("completed"), n("P").alias("failed"), n("O").alias("waiting"))


@query("SELECT doc_id, round(n_chars / 10000.0, 4) AS confidence FROM documents WHERE doc_id % 3 = 0 ORDER BY n_chars / 10000.0, doc_id LIMIT 50")
def review_queue(spark, d):
    c = F.col("n_chars") / 10000.0
    return Tables(spark, d).documents.where("doc_id % 3 = 0").orderBy(c.asc_nulls_first(), "doc_id").limit(50).select("doc_id", F.round(c, 4).alias("confidence"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY o_orderdate, o_orderkey LIMIT 1")
def fifo_head(spark, d):
    t = Tables(spark, d)
    first = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where("o_orderstatus = 'O'").join(first, "o_custkey", "left_semi").orderBy("o_orderdate", "o_orderkey").limit(1).select(F.col("o_orderkey").alias("doc_id"))


@query("SELECT user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest_status(spark, d):
    return Tables(spark, d).events.groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("status"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00'")
def ttl_filter(spark, d):
    """Entries that a time to live of one day leaves, as of 2024-01-30."""
    return Tables(spark, d).events.where(F.col("ts").cast("timestamp") > F.lit("2024-01-30").cast("timestamp") - F.expr("INTERVAL 1 DAY")).select("event_id")


@query("SELECT source, lang AS label, count(*) AS n, round(avg(n_chars), 1) AS mean_chars FROM documents GROUP BY source, lang")
def dataset_stats_labels(spark, d):
    return Tables(spark, d).documents.groupBy("source", F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 1).alias("mean_chars"))


@query("SELECT lang AS label, count(DISTINCT source) AS models FROM documents GROUP BY lang")
def dataset_coverage(spark, d):
    return Tables(spark, d).documents.groupBy(F.col("lang").alias("label")).agg(F.countDistinct("source").alias("models"))


@query("SELECT p_brand AS label, value, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, value) AS k FROM (SELECT p_brand, left(p_type, 60) AS value, count(*) AS n FROM part GROUP BY 1, 2)) WHERE k <= 10")
def dataset_top_values(spark, d):
    c = Tables(spark, d).part.groupBy(F.col("p_brand").alias("label"), F.left("p_type", F.lit(60)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "value"))).where("k <= 10").drop("k")


@query("SELECT doc_id, source, CAST(k AS INT) AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) ORDER BY k, source LIMIT 50")
def roundrobin_sample(spark, d):
    k = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return Tables(spark, d).documents.select("doc_id", "source", k.alias("turn")).where("turn <= 50").orderBy("turn", "source").limit(50)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k BETWEEN 6 AND 10")
def dataset_page_interleave(spark, d):
    k = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return Tables(spark, d).documents.withColumn("k", k).where("k between 6 and 10").select("doc_id", "source")


@query("SELECT o_orderkey AS doc_id FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def flat_pagination(spark, d):
    return Tables(spark, d).orders.select(F.col("o_orderkey").alias("doc_id")).orderBy("doc_id").offset(40).limit(20)


@query("""SELECT conv_id, label, list_words FROM (SELECT conv_id, role AS label, string_agg(text, '|' ORDER BY turn, text) AS list_words FROM conversations WHERE role <> 'system' GROUP BY conv_id, role)""")
def gt_field_dict(spark, d):
    """Labels of a document with their whole values in order; the outside label is dropped."""
    g = Tables(spark, d).conversations.where("role <> 'system'").groupBy("conv_id", F.col("role").alias("label")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("v")))).alias("x"))
    return g.select("conv_id", "label", F.array_join("x.v", "|").alias("list_words"))


@query("""WITH k AS (SELECT doc_id, unnest([concat('len', n_chars % 5), concat('lang_', lang), source]) AS field FROM documents) SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS common FROM k a JOIN k b ON a.field = b.field AND a.doc_id < b.doc_id WHERE a.doc_id // 4 = b.doc_id // 4 GROUP BY 1, 2""")
def cross_page_common_keys(spark, d):
    """Pairs of pages of one document (four pages each) that have fields in common."""
    k = Tables(spark, d).documents.select("doc_id", F.floor(F.col("doc_id") / 4).alias("g"), F.explode(F.array(F.concat(F.lit("len"), (F.col("n_chars") % 5).cast("string")), F.concat(F.lit("lang_"), "lang"), "source")).alias("field"))
    b = k.select("g", "field", F.col("doc_id").alias("doc_b"))
    return k.withColumnRenamed("doc_id", "doc_a").join(b, ["g", "field"]).where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.count(F.lit(1)).alias("common"))


_EDGES = ", ".join(f"('{a}', '{b}')" for b, alts in S.PREREQUISITES.items() for group in alts for a in group)


_ENABLED = S.PRESETS["hybrid"]
_SET = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_NEEDS = ", ".join(f"({i}, '{s}', [{', '.join(_SET(g) for g in S.PREREQUISITES[s])}]::VARCHAR[][])" for i, s in enumerate(_ENABLED))
#: Runs of eight events, each event a step of the preset that ended, by an error or well.
_ENDED = f"ended AS (SELECT event_id // 8 AS run_id, {_SET(_ENABLED)}[1 + CAST(floor(value) AS BIGINT) % {len(_ENABLED)}] AS step, event_type <> 'error' AS good FROM events)"


def _ended(t: Tables):
    step = F.get(F.array(*map(F.lit, _ENABLED)), (F.floor("value") % len(_ENABLED)).cast("int"))
    return t.events.select(F.floor(F.col("event_id") / 8).alias("run_id"), step.alias("step"), (F.col("event_type") != "error").alias("good"))


@query(f"""WITH RECURSIVE {_ENDED}, e AS (SELECT * FROM (VALUES {_EDGES}) x(step, after)), r AS (SELECT step, after FROM e UNION SELECT r.step, e.after FROM r JOIN e ON r.after = e.step),
n AS (SELECT step, count(DISTINCT run_id) AS n FROM ended WHERE NOT good GROUP BY step) SELECT step, after AS downstream, coalesce(n, 0) AS failed_runs FROM r LEFT JOIN n USING (step)""")
def dag_downstream(spark, d):
    """Every dependence of the step graph, with the runs in which a failed step holds the other one up."""
    return S.held_up(spark, _ended(Tables(spark, d)).where("not good").select("run_id", "step"))


@query(f"""WITH {_ENDED}, done AS (SELECT run_id, coalesce(list(DISTINCT step) FILTER (good), []) AS done FROM ended GROUP BY run_id)
SELECT run_id, place, step FROM done, (VALUES {_NEEDS}) t(place, step, needs) WHERE NOT list_contains(done, step)
AND len(list_filter(needs, lambda g: list_has_any(g, {_SET(_ENABLED)}) AND NOT list_has_any(list_intersect(g, {_SET(_ENABLED)}), done))) = 0""")
def available_steps(spark, d):
    """What each run may do next, after the steps that it finished."""
    done = _ended(Tables(spark, d)).groupBy("run_id").agg(F.collect_set(F.when(F.col("good"), F.col("step"))).alias("done"))
    return S.runnable(done, _ENABLED).drop("done")


@query(f"WITH {SQL_INVOICES} SELECT CAST(doc_id AS VARCHAR) AS \"InvoiceNumber\", supplier AS \"SupplierName\", CAST(invoice_date AS VARCHAR) AS \"InvoiceDate\", printf('%.2f', floor(total * 100 + 0.5) / 100) AS \"NetAmount\" FROM inv")
def export_csv(spark, d):
    i = Tables(spark, d).invoices
    return i.select(F.col("doc_id").cast("string").alias(ERP_COLUMNS["NUMBER"]), F.col("supplier").alias(ERP_COLUMNS["SUPPLIER"]), F.col("invoice_date").cast("string").alias(ERP_COLUMNS["INVOICE_DATE"]), E.money(F.col("total")).alias(ERP_COLUMNS["TOTAL"]))


def _bundles(t: Tables):
    lines = t.items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("part").cast("string").alias("description"), "quantity", "unit_price", "sub_total"))).alias("items"))
    return t.invoices.select("doc_id", "supplier", "invoice_date", "total").join(lines, "doc_id", "left")


@query(f"""WITH {SQL_INVOICES} SELECT doc_id, concat('BIG*', strftime(invoice_date, '%Y%m%d'), '*', doc_id, '**', strftime(invoice_date, '%Y%m%d'), '~') AS head, concat('TDS*', printf('%.2f', floor(total * 100 + 0.5) / 100), '~') AS tail, n_lines + 5 AS segments FROM inv""")
def export_edi(spark, d):
    e = _bundles(Tables(spark, d)).select("doc_id", F.split(E.edi_810(), "\n").alias("s"))
    n = F.size("s")
    return e.select("doc_id", F.get("s", F.lit(3)).alias("head"), F.get("s", n - 4).alias("tail"), F.split(F.get("s", n - 3), r"\*")[1].cast("long").alias("segments"))


_CUR = ' currencyID="EUR"'
_MONEY = lambda c: f"printf('%.2f', floor({c} * 100 + 0.5) / 100)"
_XMLNS = "".join(f' xmlns{p}="urn:oasis:names:specification:ubl:schema:xsd:{n}-2"' for p, n in ((":cbc", "CommonBasicComponents"), (":cac", "CommonAggregateComponents"), ("", "Invoice")))
_AMOUNTS = ", ".join(f"""'<cbc:{n}{_CUR}>', {_MONEY("total")}, '</cbc:{n}>'""" for n in ("TaxExclusiveAmount", "TaxInclusiveAmount", "PayableAmount"))


@query(f"""WITH {SQL_INVOICES}, {SQL_ITEMS}, l AS (SELECT doc_id, string_agg(concat('<cac:InvoiceLine><cbc:ID>', pos, '</cbc:ID><cac:Item><cbc:Name>', part, '</cbc:Name></cac:Item><cbc:InvoicedQuantity unitCode="C62">', {_MONEY("quantity")}, '</cbc:InvoicedQuantity><cbc:PriceAmount{_CUR}>', {_MONEY("unit_price")}, '</cbc:PriceAmount><cbc:LineExtensionAmount{_CUR}>', {_MONEY("sub_total")}, '</cbc:LineExtensionAmount></cac:InvoiceLine>'), '' ORDER BY pos) AS ls FROM items GROUP BY doc_id)
SELECT doc_id, concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10), '<Invoice{_XMLNS}><cbc:ID>', doc_id, '</cbc:ID><cbc:IssueDate>', invoice_date, '</cbc:IssueDate><cbc:DocumentCurrencyCode>EUR</cbc:DocumentCurrencyCode><cbc:InvoiceTypeCode>380</cbc:InvoiceTypeCode>',
  coalesce('<cac:AccountingSupplierParty><cac:Party><cac:PartyName><cbc:Name>' || supplier || '</cbc:Name></cac:PartyName></cac:Party></cac:AccountingSupplierParty>', ''), '<cac:LegalMonetaryTotal>', {_AMOUNTS}, '</cac:LegalMonetaryTotal>', coalesce(ls, ''), '</Invoice>') AS xml FROM inv LEFT JOIN l USING (doc_id)""")
def export_ubl(spark, d):
    return _bundles(Tables(spark, d)).select("doc_id", E.ubl_invoice().alias("xml"))


@query("""WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT 0 AS place, 'big' AS step, true AS good, count(*) AS n FROM big UNION ALL SELECT 1, 'broken', false, NULL
UNION ALL SELECT 2, 'open', true, count(*) FILTER (o_orderstatus = 'O') FROM big UNION ALL SELECT 3, 'half', true, count(*) FILTER (o_orderstatus = 'O') FROM big""")
def steps_log(spark, d):
    """Four steps of a registry on the orders, with the rows behind each; the second can't be planned and is left out."""
    steps = {"big": lambda o: o.where("o_totalprice > 100000"), "broken": lambda o: o.select("no_such_column"), "open": lambda o: o.where("o_orderstatus = 'O'"), "half": lambda o: o.withColumn("half", F.col("o_totalprice") / 2)}
    run = S.run_steps(Tables(spark, d).orders, steps)
    rows = run.rows()
    return spark.createDataFrame([(p, n, e is None, rows.get(p)) for p, n, _, e in run.log], "place int, step string, good boolean, n long")
