"""Queries over the scalar library: numbers, dates, formats, similarities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..registry import query
from ..sources.tables import SQL_NUMBERS, Tables

_NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _guard(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '{_NUM}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


_S9 = "translate(value, '€$£¥₽₩₨₱₿', '')"
_TIGHT = f"regexp_replace({_S9}, '\\s+', '', 'g')"
_SWAP = "replace(replace(s, '.', ''), ',', '.')"
_LAST = "strpos(reverse(s), ',') < strpos(reverse(s), '.')"
_PARSERS = {
    "parse_number_simple": (N.parse_simple, f"SELECT id, {_guard(chr(116) + 'ranslate(replace(trim(value), chr(44), chr(46)), ' + repr('€$£') + ', ' + repr('') + ')')} AS number FROM numbers"),
    "parse_number_broad": (N.parse_broad, f"SELECT id, {_guard(f'CASE WHEN contains(s, chr(44)) AND contains(s, chr(46)) THEN CASE WHEN {_LAST} THEN {_SWAP} ELSE replace(s, chr(44), {chr(39) * 2}) END ELSE replace(s, chr(44), chr(46)) END')} AS number FROM (SELECT id, {_TIGHT} AS s FROM numbers)"),
    "parse_number_careful": (N.parse_careful, f"SELECT id, {_guard('v')} AS number FROM (SELECT id, CASE WHEN contains(s, ',') AND contains(s, '.') THEN CASE WHEN {_LAST} THEN {_SWAP} ELSE replace(s, ',', '') END WHEN contains(s, ',') THEN CASE WHEN regexp_matches(s, '^[^,]*,[^,]{{0,2}}$') THEN replace(s, ',', '.') ELSE replace(s, ',', '') END ELSE s END AS v FROM (SELECT id, {_TIGHT} AS s FROM numbers))"),
    "parse_number_plain": (N.parse_plain, f"SELECT id, {_guard('v')} AS number FROM (SELECT id, replace(trim(value), ',', '.') AS v FROM numbers)"),
    "parse_number_or_zero": (N.parse_or_zero, f"SELECT id, coalesce({_guard('v')}, 0.0) AS number FROM (SELECT id, replace(translate(value, ' €$', ''), ',', '.') AS v FROM numbers)"),
    "normal_number": (N.normal_number, f"SELECT id, CASE WHEN contains(v, '.') THEN rtrim(rtrim(v, '0'), '.') ELSE v END AS number FROM (SELECT id, replace(replace({_S9}, ' ', ''), ',', '.') AS v FROM numbers)"),
    "export_number": (N.export_number, f"SELECT id, CASE WHEN regexp_matches(value, '^[0-9.,]+$') THEN printf('%.2f', floor(coalesce({_guard('v')}, 0.0) * 100 + 0.5) / 100) ELSE '0.00' END AS number FROM (SELECT id, value, replace(value, ',', '.') AS v FROM numbers)"),
}


def _register(name: str, parser, sql: str) -> None:
    query(f"WITH {SQL_NUMBERS} {sql}", name)(lambda spark, d: Tables(spark, d).numbers.select("id", parser(F.col("value")).alias("number")))


for _name, (_parser, _sql) in _PARSERS.items():
    _register(_name, _parser, _sql)


@query("""SELECT doc_id, lower(trim(regexp_replace(translate(translate(t, '€$£¥₽₩₨₱₿', ''), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'), '[^\\x00-\\x7F]', '', 'g'))) AS folded
FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents)""")
def accent_fold(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.fold(F.get(F.split("text", "\n"), F.lit(0))).alias("folded"))


_IBAN = "concat(CASE WHEN s_suppkey % 2 = 0 THEN 'GB82 WEST 1234 5698 7654 ' ELSE 'DE89 3704 0044 0532 0130 ' END, lpad(CAST(s_suppkey % 40 AS VARCHAR), 2, '0'))"


@query(f"""WITH i AS (SELECT s_suppkey, {_IBAN} AS iban, replace({_IBAN}, ' ', '') AS c FROM supplier), t AS (SELECT s_suppkey, iban, c, string_split(c[5:] || c[:4], '') AS ds FROM i)
SELECT s_suppkey AS id, iban, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(ds, lambda x: CASE WHEN ascii(x) >= 65 THEN ascii(x) - 55 ELSE ascii(x) - 48 END)),
  lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1 AS valid FROM t""")
def iban_mod97(spark, d):
    k = F.col("s_suppkey")
    iban = F.concat(F.when(k % 2 == 0, "GB82 WEST 1234 5698 7654 ").otherwise("DE89 3704 0044 0532 0130 "), F.lpad((k % 40).cast("string"), 2, "0"))
    return Tables(spark, d).supplier.select(k.alias("id"), iban.alias("iban")).withColumn("valid", X.iban_ok(F.col("iban")))


_DATES = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE 'not-a-date' END"""


def _date_strings(t: Tables):
    forms = [F.date_format("o_orderdate", f) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy")] + [F.lit("not-a-date")]
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), F.get(F.array(*forms), (F.col("o_orderkey") % 6).cast("int")).alias("value"))


@query(f"""SELECT doc_id, CAST(coalesce(try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%d-%m-%Y')) AS DATE)::VARCHAR AS parsed
FROM (SELECT o_orderkey AS doc_id, {_DATES} AS v FROM orders)""")
def date_parse_dayfirst(spark, d):
    return _date_strings(Tables(spark, d)).select("doc_id", X.first_date(F.col("value"), X.DAY_FIRST).cast("string").alias("parsed"))


@query(f"""SELECT rule, count(*) AS n, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS rate FROM (
  SELECT 'date' AS rule, coalesce(try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%d-%m-%Y')) IS NOT NULL AS ok FROM (SELECT {_DATES} AS v FROM orders)
  UNION ALL SELECT 'identifier', regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9\\s._/-]{{1,48}}[A-Za-z0-9]$|^[A-Za-z0-9]{{3,50}}$') FROM customer
  UNION ALL SELECT 'account_number', regexp_matches(p_type, '^[A-Za-z0-9\\s-]{{4,34}}$') FROM part) GROUP BY rule""")
def format_compliance(spark, d):
    t = Tables(spark, d)
    dates = _date_strings(t).select(F.lit("date").alias("rule"), X.first_date(F.col("value"), X.DAY_FIRST).isNotNull().alias("ok"))
    ids = t.customer.select(F.lit("identifier"), F.col("c_name").rlike(r"^[A-Za-z0-9][A-Za-z0-9\s._/-]{1,48}[A-Za-z0-9]$|^[A-Za-z0-9]{3,50}$"))
    accounts = t.part.select(F.lit("account_number"), F.col("p_type").rlike(r"^[A-Za-z0-9\s-]{4,34}$"))
    return dates.union(ids).union(accounts).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("rate"))


_LOW = "list_filter(string_split(lower({}), ' '), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT p_partkey AS id, {_LOW.format('p_name')} AS a, {_LOW.format("concat(p_type, ' ', p_name)")} AS b FROM part)
SELECT id, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS score FROM t""")
def jaccard_tokens(spark, d):
    return Tables(spark, d).part.select(F.col("p_partkey").alias("id"), X.jaccard(X.tokens(F.lower("p_name")), X.tokens(F.lower(F.concat_ws(" ", "p_type", "p_name")))).alias("score"))


@query("SELECT p_partkey AS id, round(1 - levenshtein(lower(p_name), lower(p_type)) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE), 4) AS score FROM part")
def levenshtein_similarity(spark, d):
    return Tables(spark, d).part.select(F.col("p_partkey").alias("id"), F.round(1 - F.levenshtein(F.lower("p_name"), F.lower("p_type")) / F.greatest(F.length("p_name"), F.length("p_type")), 4).alias("score"))


@query(f"""WITH t AS (SELECT p_partkey AS id, {_LOW.format('p_name')} AS a, {_LOW.format("concat(p_type, ' ', p_name)")} AS b FROM part)
SELECT id, round(CASE WHEN len(a) = 1 AND len(b) = 1 THEN round(1 - levenshtein(a[1], b[1]) / CAST(greatest(length(a[1]), length(b[1])) AS DOUBLE), 3) ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM t""")
def token_f1(spark, d):
    return Tables(spark, d).part.select(F.col("p_partkey").alias("id"), F.round(X.token_f1(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")), 6).alias("f1"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(e, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings, q)
SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 4) AS score FROM v""")
def cosine_similarity(spark, d):
    t = Tables(spark, d)
    one = t.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("e"))
    return t.embeddings.join(F.broadcast(one)).select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("e")), 4).alias("score"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(trunc(o_totalprice) AS BIGINT) END AS total FROM orders""")
def json_repair(spark, d):
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"total": '), F.col("o_totalprice").cast("long").cast("string"), F.lit("}"))
    raw = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).when(k % 4 == 2, F.concat(F.lit("x "), body, F.lit(" y"))).otherwise("x{")
    orders = Tables(spark, d).orders.where("o_totalprice = o_totalprice").select(k.alias("doc_id"), raw.alias("raw"))
    return orders.select("doc_id", F.try_variant_get(X.repaired_json(F.col("raw")), "$.total", "bigint").alias("total"))
