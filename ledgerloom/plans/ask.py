"""Named analytics, and the router from a question in English or French to one of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..registry import query
from ..sources.tables import SQL_INVOICES, SQL_ITEMS, Tables
from .evaluating import FLAGS_SQL, JOINED_SQL, accuracy_per_field, quality_flags, step_timings


@query(f"WITH {SQL_INVOICES} SELECT supplier, count(*) AS invoices, round(avg(total), 2) AS mean_total, round(avg(CASE WHEN n_lines > 0 THEN 1.0 ELSE 0.0 END) * 100, 2) AS found_pct FROM inv GROUP BY supplier ORDER BY invoices DESC, supplier LIMIT 5")
def ask_suppliers(spark: SparkSession, d: str) -> DataFrame:
    g = Tables(spark, d).invoices.groupBy("supplier").agg(F.count(F.lit(1)).alias("invoices"), F.round(F.avg("total"), 2).alias("mean_total"), F.round(F.avg(F.when(F.col("n_lines") > 0, 1.0).otherwise(0.0)) * 100, 2).alias("found_pct"))
    return g.orderBy(F.desc("invoices"), "supplier").limit(5)


@query(f"WITH {SQL_INVOICES} SELECT count(*) AS invoices, round(sum(total), 2) AS total, round(sum(net), 2) AS net, round(avg(total), 4) AS mean_total FROM inv")
def ask_financial(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).invoices.agg(F.count(F.lit(1)).alias("invoices"), F.round(F.sum("total"), 2).alias("total"), F.round(F.sum("net"), 2).alias("net"), F.round(F.avg("total"), 4).alias("mean_total"))


@query("SELECT event_type AS stage, round(avg(value), 4) AS mean FROM events GROUP BY event_type ORDER BY mean DESC")
def ask_performance(spark: SparkSession, d: str) -> DataFrame:
    return step_timings(spark, d).select(F.col("step").alias("stage"), "mean").orderBy(F.desc("mean"))


@query(f"{JOINED_SQL} SELECT field, count(*) AS n, CAST(sum(CAST(exact AS INT)) AS BIGINT) AS hits, round(avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END), 4) AS score FROM j GROUP BY field ORDER BY score DESC, field")
def ask_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return accuracy_per_field(spark, d).orderBy(F.desc("score"), "field")


@query(FLAGS_SQL)
def ask_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality_flags(spark, d)


@query(f"WITH {SQL_ITEMS} SELECT doc_id, pos, CAST(part AS VARCHAR) AS description, round(unit_price + 1e-7, 2) AS price FROM items WHERE doc_id IN (SELECT DISTINCT doc_id FROM items ORDER BY doc_id LIMIT 5)")
def ask_line_items(spark: SparkSession, d: str) -> DataFrame:
    items = Tables(spark, d).items
    some = items.select("doc_id").distinct().orderBy("doc_id").limit(5)
    return items.join(some, "doc_id", "left_semi").select("doc_id", "pos", F.col("part").cast("string").alias("description"), F.round(F.col("unit_price") + 1e-7, 2).alias("price"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS invoices FROM orders GROUP BY 1")
def ask_dates(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("invoices"))


@query("SELECT field, CASE WHEN share < 0.7 THEN 'improve' WHEN share < 0.8 THEN 'watch' ELSE 'keep' END AS advice FROM (SELECT lang AS field, avg(CASE WHEN doc_id % 7 = 0 THEN 0.0 WHEN n_chars < 400 THEN 0.0 ELSE 1.0 END) AS share FROM documents GROUP BY lang)")
def ask_recommendations(spark: SparkSession, d: str) -> DataFrame:
    share = F.avg(F.when((F.col("doc_id") % 7 == 0) | (F.col("n_chars") < 400), 0.0).otherwise(1.0))
    g = Tables(spark, d).documents.groupBy(F.col("lang").alias("field")).agg(share.alias("share"))
    return g.select("field", F.when(F.col("share") < 0.7, "improve").when(F.col("share") < 0.8, "watch").otherwise("keep").alias("advice"))


@query("SELECT (SELECT count(*) FROM orders) AS invoices, (SELECT count(*) FROM customer) AS suppliers, (SELECT count(*) FROM documents) AS documents")
def ask_overview(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(t.orders, "invoices").join(n(t.customer, "suppliers")).join(n(t.documents, "documents"))


HANDLERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "suppliers": ask_suppliers, "financial": ask_financial, "accuracy": ask_accuracy, "performance": ask_performance, "quality": ask_quality,
    "recommendations": ask_recommendations, "line_items": ask_line_items, "dates": ask_dates, "overview": ask_overview,
}


def route(question: str) -> str:
    """Name of the query for a question: the first word of the table that it contains, else the overview."""
    low = question.lower()
    return next((name for word, name in L.ROUTES if word in low), "overview")


def ask(spark: SparkSession, sf_dir: str, question: str) -> DataFrame:
    return HANDLERS[route(question)](spark, sf_dir)


_ROUTE = " ".join(f"WHEN contains(low, '{w}') THEN '{n}'" for w, n in L.ROUTES)


@query(f"SELECT item_id, CASE {_ROUTE} ELSE 'overview' END AS handler FROM (SELECT item_id, lower(text) AS low FROM benchmark)")
def question_routes(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    handler = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(n)) for w, n in L.ROUTES], F.lit("overview"))
    return Tables(spark, d).benchmark.select("item_id", handler.alias("handler"))
