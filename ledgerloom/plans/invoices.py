"""Queries of the rule engine: validation, anomalies, confidence, vendors, line items, merging."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import entities as N
from ..operators import linking as A
from ..operators import rules as R
from ..registry import query
from ..sources.tables import SQL_INVOICES, SQL_ITEMS, Tables

#: Expected rate and currency of a vendor by its nation.
_VAT = "CASE nationkey % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 5.5 ELSE 10.0 END"
_RATE = "CASE WHEN net > 0 THEN round((gross - net) / net * 100, 1) END"
_ISSUES = f"""WITH {SQL_INVOICES}, v AS (SELECT *, CAST({_VAT} AS DOUBLE) AS expected_vat, {_RATE} AS rate FROM inv), iss AS (
  SELECT doc_id, 'required_fields' AS rule, 'error' AS severity FROM v WHERE n_lines = 0
  UNION ALL SELECT doc_id, 'arithmetic', 'warning' FROM v WHERE net > 0 AND abs(total - net) / net > 0.02
  UNION ALL SELECT doc_id, 'vat_context', 'warning' FROM v WHERE net > 0 AND abs(rate - expected_vat) > 1.0
  UNION ALL SELECT doc_id, 'arithmetic', 'error' FROM v WHERE rate < -1.0
  UNION ALL SELECT doc_id, 'ranges', 'error' FROM v WHERE total < 0
  UNION ALL SELECT doc_id, 'unusual_total', 'warning' FROM v WHERE total > 10000000)"""


def checked(t: Tables):
    vat = F.when(F.col("nationkey") % 3 == 0, 4.0).when(F.col("nationkey") % 3 == 1, 5.5).otherwise(10.0)
    return R.issue_counts(R.invoice_issues(t.invoices.withColumn("expected_vat", vat)))


@query(f"{_ISSUES} SELECT rule, severity, count(*) AS n FROM iss GROUP BY rule, severity")
def issues_rollup(spark, d):
    return checked(Tables(spark, d)).select(F.explode("issues").alias("i")).groupBy("i.rule", "i.severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_ISSUES} SELECT v.doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS is_valid
FROM v LEFT JOIN iss USING (doc_id) GROUP BY v.doc_id""")
def validation_counts(spark, d):
    return checked(Tables(spark, d)).select("doc_id", F.col("errors").cast("long").alias("errors"), F.col("warnings").cast("long").alias("warnings"), "is_valid")


@query(f"""{_ISSUES}, c AS (SELECT v.doc_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM v LEFT JOIN iss USING (doc_id) GROUP BY v.doc_id)
SELECT doc_id, round(greatest(0.0, 1.0 - 0.3 * e - 0.15 * w), 3) AS confidence, greatest(0.0, 1.0 - 0.3 * e - 0.15 * w) < 0.7 AS needs_review, round(-0.3 * e - 0.1 * w, 3) AS adjustment FROM c""")
def confidence_direct(spark, d):
    c = R.direct_confidence(F.col("errors"), F.col("warnings"), F.lit(False))
    return checked(Tables(spark, d)).select("doc_id", F.round(c, 3).alias("confidence"), (c < R.REVIEW_BELOW).alias("needs_review"), F.round(R.validator_adjustment(F.col("errors"), F.col("warnings")), 3).alias("adjustment"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def validate_required(spark, d):
    t = Tables(spark, d)
    return t.orders.select(F.col("o_orderkey").alias("doc_id")).join(t.lineitem.select(F.col("l_orderkey").alias("doc_id")), "doc_id", "left_anti")


@query(f"WITH {SQL_ITEMS} SELECT doc_id, pos, round(round(quantity * unit_price + 1e-7, 2) - sub_total + 1e-7, 2) AS gap FROM items WHERE quantity > 0 AND unit_price > 0 AND sub_total > 0 AND abs(round(quantity * unit_price + 1e-7, 2) - sub_total) / sub_total > 0.02")
def validate_line_arithmetic(spark, d):
    return R.line_checks(Tables(spark, d).items).select("doc_id", "pos", F.round(F.col("expected") - F.col("sub_total") + 1e-7, 2).alias("gap"))


@query(f"WITH {SQL_INVOICES} SELECT doc_id, {_RATE} AS rate, NOT ({_RATE} IN (0.0, 5.5, 10.0, 20.0)) AND {_RATE} >= 0 AS odd FROM inv WHERE net > 0")
def vat_anomaly(spark, d):
    rate = R.implied_vat(F.col("net"), F.col("gross"))
    return Tables(spark, d).invoices.where("net > 0").select("doc_id", rate.alias("rate"), ((rate >= 0) & ~rate.isin(*R.VAT_RATES)).alias("odd"))


_CUR = "CASE s_nationkey % 3 WHEN 0 THEN '€' WHEN 1 THEN '$' ELSE '£' END"


@query(f"""WITH f AS (SELECT s_suppkey AS doc_id, concat({_CUR}, CAST(s_suppkey AS VARCHAR)) AS total, concat(CASE WHEN s_suppkey % 5 = 0 THEN '€' ELSE {_CUR} END, '7') AS total_amount, {_CUR} AS expected FROM supplier)
SELECT doc_id, CAST(list_unique(list_filter(['€', '$', '£', '¥', '₽', '₹', '₩'], lambda s: contains(total || total_amount, s))) > 1 AS BOOLEAN) AS mixed, left(total_amount, 1) <> expected AS off_vendor FROM f""")
def validate_currency(spark, d):
    n = F.col("s_nationkey") % 3
    sign = F.when(n == 0, "€").when(n == 1, "$").otherwise("£")
    f = Tables(spark, d).supplier.select(F.col("s_suppkey").alias("doc_id"), F.concat(sign, F.col("s_suppkey").cast("string")).alias("total"), F.concat(F.when(F.col("s_suppkey") % 5 == 0, "€").otherwise(sign), F.lit("7")).alias("total_amount"), sign.alias("expected"))
    return f.select("doc_id", (X.count_contained(F.concat("total", "total_amount"), ["€", "$", "£", "¥", "₽", "₹", "₩"]) > 1).alias("mixed"), (F.substring("total_amount", 1, 1) != F.col("expected")).alias("off_vendor"))


@query(f"""WITH {SQL_INVOICES}, all_inv AS (SELECT doc_id, vendor_id, invoice_date, total, doc_id AS arrival FROM inv UNION ALL SELECT doc_id + 10000000, vendor_id, invoice_date + 7, total, doc_id + 10000000 FROM inv WHERE doc_id % 50 = 0)
SELECT n.doc_id, min(o.doc_id) AS duplicate_of FROM all_inv n JOIN all_inv o ON o.vendor_id = n.vendor_id AND o.arrival < n.arrival AND o.invoice_date >= n.invoice_date - 30 AND abs(n.total - o.total) < 0.01 WHERE n.total <> 0 AND o.total <> 0 GROUP BY n.doc_id""")
def duplicate_invoice_30d(spark, d):
    inv = Tables(spark, d).invoices.select("doc_id", "vendor_id", "invoice_date", "total", F.col("doc_id").alias("arrival"))
    again = inv.where("doc_id % 50 = 0").select(F.col("doc_id") + 10_000_000, "vendor_id", F.date_add("invoice_date", 7), "total", F.col("arrival") + 10_000_000)
    return R.duplicates(inv.union(again))


@query(f"""WITH {SQL_INVOICES}, h AS (SELECT doc_id, total, count(total) OVER w AS n, avg(total) OVER w AS m, stddev_samp(total) OVER w AS s FROM inv WINDOW w AS (PARTITION BY vendor_id ORDER BY invoice_date, doc_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
SELECT doc_id, n, round(m, 2) AS mean, round(total, 2) AS total FROM h WHERE n >= 5 AND s > 0 AND total > m + 3 * s""")
def amount_anomaly_3sigma(spark, d):
    return R.amount_anomalies(Tables(spark, d).invoices).select("doc_id", "n", F.round("mean", 2).alias("mean"), F.round("total", 2).alias("total"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2001-06-01'")
def future_date(spark, d):
    return Tables(spark, d).orders.where(F.col("o_orderdate").cast("date") > F.lit("2001-06-01").cast("date")).select(F.col("o_orderkey").alias("doc_id"))


@query(f"""WITH {SQL_ITEMS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT concat_ws('|', part, quantity)) AS BIGINT) AS repeated, round(sum(sub_total) + 1e-5, 2) AS total FROM items GROUP BY doc_id""")
def merge_consistency(spark, d):
    return Tables(spark, d).items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("part", "quantity")).alias("repeated"), F.round(F.sum("sub_total") + 1e-5, 2).alias("total"))


@query(f"WITH {SQL_ITEMS} SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY pos) AS k FROM items) WHERE k > 1")
def line_dedupe(spark, d):
    seen = F.row_number().over(W.partitionBy("doc_id", "part").orderBy("pos"))
    return Tables(spark, d).items.withColumn("k", seen).where("k > 1").select("doc_id", "pos")


def _arrays(t: Tables):
    lists = t.items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "quantity", "unit_price"))).alias("x"))
    return lists.select("doc_id", F.col("x.part").alias("description"), F.col("x.quantity").alias("quantity"), F.slice("x.unit_price", 1, 3).alias("unit_price"))


@query(f"""WITH {SQL_ITEMS} SELECT doc_id, pos, part AS description, quantity, CASE WHEN pos <= 3 THEN round(unit_price + 1e-7, 2) END AS unit_price FROM items""")
def lineitems_zip(spark, d):
    """Parallel lists, of which one is short, become rows again."""
    z = _arrays(Tables(spark, d)).select("doc_id", F.posexplode(F.arrays_zip("description", "quantity", "unit_price")).alias("pos", "i"))
    return z.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "i.description", "i.quantity", F.round(F.col("i.unit_price") + 1e-7, 2).alias("unit_price"))


@query(f"WITH {SQL_ITEMS} SELECT doc_id, string_agg(concat(part, ' ', CAST(quantity AS BIGINT)), '; ' ORDER BY pos) AS line_text FROM items GROUP BY doc_id")
def lineitems_text(spark, d):
    text = F.concat_ws(" ", F.col("part").cast("string"), F.col("quantity").cast("long").cast("string"))
    rows = Tables(spark, d).items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("s")))).alias("x"))
    return rows.select("doc_id", F.array_join("x.s", "; ").alias("line_text"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part, CAST(l_quantity AS BIGINT) AS quantity, CASE l_partkey % 3 WHEN 0 THEN 'Unités' WHEN 1 THEN 'kg' ELSE '' END AS uom FROM lineitem")
def qty_uom_split(spark, d):
    """A quantity such as `12,00 kg` becomes number and unit."""
    k = F.col("l_partkey") % 3
    raw = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(",00"), F.when(k == 0, " Unités").when(k == 1, " kg").otherwise(""))
    rows = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), raw.alias("raw"))
    number = F.replace(F.regexp_extract("raw", r"^([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit("."))
    return rows.select("doc_id", "line", "part", number.cast("double").cast("long").alias("quantity"), F.trim(F.regexp_extract("raw", r"^[0-9.,]+\s*(.*)$", 1)).alias("uom"))


_QNAME = "CASE s_suppkey % 3 WHEN 0 THEN upper(s_name) WHEN 1 THEN concat(s_name, ' SARL') ELSE concat('Ste ', replace(s_name, '#', ' ')) END"


@query(f"""WITH q AS (SELECT s_suppkey AS query_id, list_filter(string_split(lower(replace({_QNAME}, '#', ' ')), ' '), lambda x: x <> '' AND x NOT IN ('sarl', 'ste')) AS a FROM supplier),
v AS (SELECT s_suppkey AS vendor_id, list_filter(string_split(lower(replace(s_name, '#', ' ')), ' '), lambda x: x <> '') AS b FROM supplier),
s AS (SELECT query_id, vendor_id, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS score FROM q, v)
SELECT query_id, vendor_id, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vendor_id) AS k FROM s) WHERE k = 1 AND score >= 0.8""")
def vendor_match_jaccard(spark, d):
    """Best vendor by shared words. Words are ordered by how rare they are; a pair of Jaccard similarity 0.8 shares one of the
    rarest n - ceil(0.8 n) + 1 words of either name, so only those are joined on, and each pair is counted once."""
    k = F.col("s_suppkey") % 3
    asked = F.when(k == 0, F.upper("s_name")).when(k == 1, F.concat("s_name", F.lit(" SARL"))).otherwise(F.concat(F.lit("Ste "), F.replace("s_name", F.lit("#"), F.lit(" "))))
    words = lambda c: F.array_distinct(F.filter(X.tokens(F.lower(F.replace(c, F.lit("#"), F.lit(" ")))), lambda w: ~w.isin("sarl", "ste")))
    s = Tables(spark, d).supplier
    q = s.select(F.col("s_suppkey").alias("query_id"), words(asked).alias("a"))
    v = s.select(F.col("s_suppkey").alias("vendor_id"), words(F.col("s_name")).alias("b"))
    met = N.by_rare_words(q, v, 0.8)
    score = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vendor_id"))
    return met.withColumn("score", score).withColumn("k", best).where("k = 1 and score >= 0.8").select("query_id", "vendor_id", F.round("score", 3).alias("score"))


@query("SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_nationkey")
def supplier_rollup(spark, d):
    return Tables(spark, d).customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query(f"""WITH {SQL_INVOICES} SELECT vendor_id, count(*) AS invoices, round(sum(total), 2) AS amount, CAST(min(invoice_date) AS VARCHAR) AS first_seen, CAST(max(invoice_date) AS VARCHAR) AS last_seen FROM inv GROUP BY vendor_id""")
def supplier_totals(spark, d):
    return Tables(spark, d).orders.groupBy(F.col("o_custkey").alias("vendor_id")).agg(F.count(F.lit(1)).alias("invoices"), F.round(F.sum("o_totalprice"), 2).alias("amount"), F.min(F.col("o_orderdate").cast("date")).cast("string").alias("first_seen"), F.max(F.col("o_orderdate").cast("date")).cast("string").alias("last_seen"))


@query("""WITH p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS v, o_totalprice AS amount FROM orders)
SELECT doc_id, max_by(v, page) FILTER (v IS NOT NULL) AS priority, string_agg(CAST(CAST(trunc(amount) AS BIGINT) AS VARCHAR), ',' ORDER BY page) AS amounts FROM p GROUP BY doc_id""")
def pages_stitch(spark, d):
    """Merge of pages: the last value that isn't null, lists end to end in page order."""
    page = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    p = Tables(spark, d).orders.select(F.col("o_custkey").alias("doc_id"), page.alias("page"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("v"), F.col("o_totalprice").cast("long").cast("string").alias("amount"))
    m = p.groupBy("doc_id").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("page"))).alias("priority"), F.array_sort(F.collect_list(F.struct("page", "amount"))).alias("x"))
    return m.select("doc_id", "priority", F.array_join("x.amount", ",").alias("amounts"))


@query("""WITH p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderstatus AS type FROM orders),
g AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id, type ORDER BY page) AS run FROM p)
SELECT doc_id, type, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM g GROUP BY doc_id, type, run""")
def page_groups_islands(spark, d):
    w = W.partitionBy("doc_id").orderBy("page")
    p = Tables(spark, d).orders.select(F.col("o_custkey").alias("doc_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("page"), F.col("o_orderstatus").alias("type"))
    runs = p.withColumn("new", (F.lag("type").over(w).isNull() | (F.lag("type").over(w) != F.col("type"))).cast("int")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("doc_id", "type", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("n")).drop("run")


@query("""WITH v AS (SELECT l_orderkey AS doc_id, l_returnflag AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS model FROM lineitem),
c AS (SELECT doc_id, value, count(*) AS n, min(model) AS first FROM v GROUP BY doc_id, value)
SELECT doc_id, arg_max(value, n * 1000 - first) AS value, round(max(n) / CAST(sum(n) AS DOUBLE), 4) AS agreement FROM c GROUP BY doc_id""")
def ensemble_vote(spark, d):
    """Most frequent value among models, of equal ones that of the first model; share of models that agree."""
    model = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    v = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("value"), model.alias("model"))
    c = v.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"), F.min("model").alias("first"))
    return c.groupBy("doc_id").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"), F.round(F.max("n") / F.sum("n"), 4).alias("agreement"))


def _asked_names(t: Tables):
    k = F.col("s_suppkey") % 3
    asked = F.when(k == 0, F.upper("s_name")).when(k == 1, F.concat("s_name", F.lit(" SARL"))).otherwise(F.concat(F.lit("Ste "), F.replace("s_name", F.lit("#"), F.lit(" "))))
    return t.supplier.select(F.col("s_suppkey").alias("id"), asked.alias("name"))


#: Longest common subsequence of two lists of character codes `x` and `y`, by a fold over rows of the table.
_LCS = """list_reduce(list_concat([list_transform(range(len(y) + 1), lambda j: 0)], list_transform(x, lambda c: [c])), lambda above, c:
  list_reduce(list_concat([[0]], list_transform(range(1, len(y) + 1), lambda j: [j])), lambda out, j: list_append(out, CASE WHEN y[j[1]] = c[1] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], out[-1]) END)))[-1]"""
_SORTED = "array_to_string(list_sort(list_filter(string_split(lower({0}), ' '), lambda w: w <> '')), ' ')"
_CODES = "list_transform(string_split({0}, ''), lambda c: ord(c))"
_RATIO = f"2.0 * {_LCS} / (len(x) + len(y))"


@query(f"""WITH a AS (SELECT s_suppkey AS id, {_SORTED.format(_QNAME)} AS p FROM supplier), b AS (SELECT s_suppkey AS vendor_id, {_SORTED.format("s_name")} AS q FROM supplier),
s AS (SELECT id, vendor_id, {_RATIO} AS score FROM (SELECT id, vendor_id, {_CODES.format("p")} AS x, {_CODES.format("q")} AS y FROM a, b))
SELECT id, vendor_id, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vendor_id) AS k FROM s) WHERE k = 1 AND score >= 0.8""")
def vendor_match_ratio(spark, d):
    """Best vendor by sorted-token similarity behind a filter that loses no pair."""
    t = Tables(spark, d)
    return N.best_vendor(_asked_names(t), t.supplier.select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor")))


@query(f"""WITH a AS (SELECT CAST(n_nationkey AS BIGINT) AS id, {_SORTED.format("n_name")} AS p FROM nation), s AS (SELECT id, other, {_RATIO} AS score FROM (SELECT a.id, b.id AS other, {_CODES.format("a.p")} AS x, {_CODES.format("b.p")} AS y FROM a JOIN a b ON a.id < b.id))
SELECT id, other, round(score, 3) AS score, round(least(1.0, 1.2 * score), 3) AS confidence FROM s WHERE score >= 0.6""")
def supplier_edges(spark, d):
    return N.likely_same(Tables(spark, d).nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))


@query(f"""WITH RECURSIVE a AS (SELECT CAST(n_nationkey AS BIGINT) AS id, {_SORTED.format("n_name")} AS p FROM nation UNION ALL SELECT n_nationkey + 100, {_SORTED.format("n_name")} FROM nation),
s AS (SELECT id, other, {_RATIO} AS score FROM (SELECT a.id, b.id AS other, {_CODES.format("a.p")} AS x, {_CODES.format("b.p")} AS y FROM a JOIN a b ON a.id <> b.id)), l AS (SELECT id, other FROM s WHERE score >= 0.8),
r AS (SELECT id, id AS entity FROM a UNION SELECT l.id, r.entity FROM r JOIN l ON l.other = r.id) SELECT id, min(entity) AS entity FROM r GROUP BY id""")
def supplier_entities(spark, d):
    n = Tables(spark, d).nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    twice = n.union(n.select(F.col("id") + 100, F.concat("name", F.lit(" LTD"))))
    return N.entities(twice.select("id", N.normal_name(F.col("name")).alias("name")))


#: Three arrivals of each document, named by its first two words: as they are, with a legal form and a letter less, and with
#: a prefix and a letter more.
_ARRIVALS = f"""raw AS (SELECT 3 * doc_id + i AS id, CASE i WHEN 0 THEN b WHEN 1 THEN concat(left(b, length(b) - 1), ' LTD') ELSE concat('Ste ', b, 'x') END AS name
  FROM (SELECT doc_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS b FROM documents), (SELECT unnest([0, 1, 2]) AS i)),
words AS (SELECT id, CASE WHEN trim(name) = '' THEN 'Unknown' ELSE name END AS name FROM raw),
keyed AS (SELECT id, name, array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower(trim(name)), '[^\\pL\\pN_\\s&.-]', '', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ({", ".join(repr(w) for w in [*N.LEGAL, *N.PREFIXES, *N.SMALL])}))), ' ') AS key FROM words),
one AS (SELECT key, regexp_replace(strip_accents(key), '[^ -~]', '?', 'g') AS plain, min(id) AS id FROM keyed GROUP BY key),
near AS (SELECT id, other, {_RATIO} AS score FROM (SELECT a.id, b.id AS other, {_CODES.format("a.key")} AS x, {_CODES.format("b.key")} AS y FROM one a JOIN one b ON b.id < a.id
  WHERE a.key <> '' AND b.key <> '' AND levenshtein(a.plain, b.plain) <= 0.2 * (length(a.key) + length(b.key)) + 1e-9) WHERE {_RATIO} >= 0.8),
best AS (SELECT id, other FROM (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM near) WHERE score = top),
tree AS (SELECT id, id AS entity FROM one WHERE id NOT IN (SELECT id FROM best) UNION SELECT best.id, tree.entity FROM tree JOIN best ON best.other = tree.id),
linked AS (SELECT k.id, k.name, k.key, min(t.entity) AS entity FROM keyed k JOIN one o ON k.key = o.key JOIN tree t ON t.id = o.id GROUP BY ALL)"""


def _arrivals(t: Tables):
    b = F.substring_index("text", " ", 2)  # a text is not split any further
    d = t.documents.select("doc_id", b.alias("b"))
    kinds = [F.col("b"), F.concat(F.expr("left(b, length(b) - 1)"), F.lit(" LTD")), F.concat(F.lit("Ste "), "b", F.lit("x"))]
    return d.select("doc_id", F.posexplode(F.array(*kinds)).alias("i", "name")).select((3 * F.col("doc_id") + F.col("i")).alias("id"), "name")


@query(f"WITH RECURSIVE {_ARRIVALS} SELECT id, entity FROM linked")
def supplier_arrivals(spark, d):
    """Each name's entity when names join the entity of the most similar earlier name or open one."""
    return A.linked_suppliers(_arrivals(Tables(spark, d)))


@query(f"""WITH RECURSIVE {_ARRIVALS}, forms AS (SELECT entity, key, min(id) AS id, arg_min(name, id) AS name, count(*) AS n FROM linked GROUP BY entity, key)
SELECT entity, arg_min(name, id) AS canonical, string_agg(name, '; ' ORDER BY id) AS variations, CAST(sum(n) AS BIGINT) AS invoices FROM forms GROUP BY entity""")
def supplier_entity_list(spark, d):
    """The entities with their first names, variations and numbers of invoices."""
    names = _arrivals(Tables(spark, d))
    return A.entity_list(names, A.linked_suppliers(names)).withColumn("variations", F.array_join("variations", "; "))


@query("""WITH p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderstatus AS type FROM orders), h AS (SELECT * FROM p WHERE page % 4 <> 0),
g AS (SELECT *, CASE WHEN type = lag(type) OVER w THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY page)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM g)
SELECT doc_id, type, array_to_string(range(min(page), max(page) + 1), ',') AS pages FROM r GROUP BY doc_id, type, run""")
def page_groups_filled(spark, d):
    """Runs of equal page types; a page number that is missing inside a run belongs to it."""
    page = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    p = Tables(spark, d).orders.select(F.col("o_custkey").alias("doc_id"), page.alias("page"), F.col("o_orderstatus").alias("type")).where("page % 4 <> 0")
    w = W.partitionBy("doc_id").orderBy("page")
    runs = p.withColumn("new", F.when(F.lag("type").over(w) == F.col("type"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("doc_id", "type", "run").agg(F.array_join(F.sequence(F.min("page"), F.max("page")).cast("array<string>"), ",").alias("pages")).drop("run")
