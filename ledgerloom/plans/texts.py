"""Queries on texts: chunks, hashes, classes, languages, keywords, markdown and pipe tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators.classify import classify_counted, classify_documents, classify_weighted, document_types
from ..operators.chunks import fixed_chunks, sentence_chunks
from ..operators.pipe_tables import table_items
from ..registry import query
from ..sources.tables import SQL_ITEMS, Tables

_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


@query("""SELECT doc_id, CAST(i AS INT) AS chunk, substr(text, i * 800 + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def doc_chunk_fixed(spark, d):
    return fixed_chunks(Tables(spark, d).documents)


_MARK = "list_min(list_filter([position('.' IN z), position('!' IN z), position('?' IN z)], lambda p: p > 0))"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS s, CASE WHEN length(text) <= 1000 THEN length(text) ELSE least(length(text), 800 + coalesce((SELECT {_MARK} FROM (SELECT substr(text, 801, 200) AS z)), 200)) END AS e FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, n, CASE WHEN n + 1000 < length(text) THEN n + 800 + coalesce(m, 200) ELSE length(text) END FROM (SELECT doc_id, text, n, (SELECT {_MARK} FROM (SELECT substr(text, n + 801, 200) AS z)) AS m FROM (SELECT doc_id, text, greatest(e - 200, s + 1) AS n, e FROM c) WHERE e < length(text))),
p AS (SELECT doc_id, s, e, trim(substr(text, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(13)) AS content FROM c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", content, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total FROM p WHERE content <> ''""")
def doc_chunk_sentence(spark, d):
    return sentence_chunks(Tables(spark, d).documents.select("doc_id", "text"))


@query("SELECT doc_id, n, CASE WHEN n = 1 THEN 'single_page' WHEN n <= 5 THEN 'short_document' ELSE 'long_document' END AS kind FROM (SELECT doc_id, CAST(ceil(length(text) / 2000.0) AS BIGINT) AS n FROM documents)")
def doc_length_bucket(spark, d):
    n = F.ceil(F.length("text") / 2000).cast("long")
    return Tables(spark, d).documents.select("doc_id", n.alias("n"), F.when(n == 1, "single_page").when(n <= 5, "short_document").otherwise("long_document").alias("kind"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_repeats(spark, d):
    return Tables(spark, d).documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT doc_id, left(sha256(text), 16) || '_' || left(sha256('fast|' || lang || '|a'), 12) AS key FROM documents")
def result_cache_keys(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.concat(F.left(F.sha2("text", 256), F.lit(16)), F.lit("_"), F.left(F.sha2(F.concat(F.lit("fast|"), "lang", F.lit("|a")), 256), F.lit(12))).alias("key"))


@query("""SELECT word, n FROM (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE length(w) > 3 GROUP BY 1) ORDER BY n DESC, word LIMIT 50""")
def keyword_frequency(spark, d):
    words = Tables(spark, d).documents.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).where(F.length("w") > 3)
    return words.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(f"SELECT doc_id, CAST(len(list_filter({_LIST(L.FRENCH_INDICATORS)}, lambda w: contains(lower(text), w))) AS INT) AS hits, len(list_filter({_LIST(L.FRENCH_INDICATORS)}, lambda w: contains(lower(text), w))) >= 3 AS french FROM documents")
def language_french_score(spark, d):
    hits = X.count_contained(F.lower("text"), L.FRENCH_INDICATORS)
    return Tables(spark, d).documents.select("doc_id", hits.alias("hits"), (hits >= 3).alias("french"))


@query(f"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zàâäéèêëïîôùûüÿçœæ]+')) AS ws FROM documents)
SELECT doc_id, CASE WHEN len(list_intersect(ws, {_LIST(L.FRENCH_KEYWORDS)})) > len(list_intersect(ws, {_LIST(L.ENGLISH_KEYWORDS)})) THEN 'fr' ELSE 'en' END AS language FROM w""")
def language_keyword(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zàâäéèêëïîôùûüÿçœæ]+"), F.lit(0))
    hits = lambda xs: F.size(F.array_intersect(words, F.array(*[F.lit(x) for x in xs])))
    return Tables(spark, d).documents.select("doc_id", F.when(hits(L.FRENCH_KEYWORDS) > hits(L.ENGLISH_KEYWORDS), "fr").otherwise("en").alias("language"))


def _weighted_sql(extra: float, table: str = "documents") -> str:
    hits = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, {i} AS ord, len(list_filter({_LIST(ws)}, lambda w: contains(lower(text), w))) * {w + extra} AS score FROM {table}" for i, (k, (w, ws)) in enumerate(L.PAGE_SIGNATURES.items()))
    return f"""WITH s AS (SELECT * FROM ({hits}) WHERE score > 0), b AS (SELECT doc_id, arg_max(type, score * 1000 - ord) AS type, max(score) AS top, sum(score) AS total FROM s GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN b.doc_id IS NULL OR least(1.0, top / greatest(total - top + 1, 1)) < 0.5 THEN 'other' ELSE type END AS type,
  CASE WHEN length(trim(text)) < 5 OR b.doc_id IS NULL THEN 0.5 ELSE round(least(1.0, CAST(top AS DOUBLE) / greatest(total - top + 1, 1)), 3) END AS confidence FROM {table} d LEFT JOIN b USING (doc_id)"""


@query(_weighted_sql(0.2))
def page_classify_weighted(spark, d):
    return classify_weighted(Tables(spark, d).documents.select("doc_id", "text"))


_COUNTS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, {i} AS ord, len(list_filter({_LIST(ws)}, lambda w: contains(lower(text), w))) AS score FROM documents" for i, (k, ws) in enumerate(L.PAGE_KEYWORDS.items()))


@query(f"""WITH s AS (SELECT * FROM ({_COUNTS}) WHERE score > 0), b AS (SELECT doc_id, arg_max(type, score * 1000 - ord) AS type, max(score) AS top, sum(score) AS total FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(type, 'UNKNOWN') AS type, CASE WHEN b.doc_id IS NULL THEN 0.0 ELSE round(least(0.95, 1.5 * top / CAST(total AS DOUBLE)), 3) END AS confidence FROM documents d LEFT JOIN b USING (doc_id)""")
def page_classify_count(spark, d):
    return classify_counted(Tables(spark, d).documents.select("doc_id", "text"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source, lang), b AS (SELECT source, arg_max(lang, n * 1000000000 - first) AS type, max(n) AS top, sum(n) AS total FROM c GROUP BY source)
SELECT source, CASE WHEN top / CAST(total AS DOUBLE) >= 0.6 THEN type ELSE 'unknown' END AS type, round(top / CAST(total AS DOUBLE), 4) AS share FROM b""")
def doc_type_majority(spark, d):
    c = Tables(spark, d).documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    b = c.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("type"), (F.max("n") / F.sum("n")).alias("share"))
    return b.select("source", F.when(F.col("share") >= 0.6, F.col("type")).otherwise("unknown").alias("type"), F.round("share", 4).alias("share"))


_SEP = "'^[|:\\s-]*-[|:\\s-]*$'"


@query(f"""SELECT page_id, coalesce(array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda s: trim(s) <> '' AND NOT regexp_matches(trim(s), {_SEP})), lambda s: CASE WHEN starts_with(trim(s), '|') THEN trim(replace(s, '|', '')) ELSE trim(s) END), chr(10)), '') AS plain
FROM (SELECT page_id, concat('# ', url, chr(10), chr(10), '| a | ', page_id, ' |', chr(10), '|---|---|', chr(10), '| ', url, ' | x |') AS t FROM pages)""")
def strip_markdown(spark, d):
    page = F.concat(F.lit("# "), "url", F.lit("\n\n| a | "), F.col("page_id").cast("string"), F.lit(" |\n|---|---|\n| "), "url", F.lit(" | x |"))
    return Tables(spark, d).pages.select("page_id", X.strip_markdown(page).alias("plain"))


@query(f"WITH {SQL_ITEMS} SELECT doc_id, pos - 1 AS row, CAST(part AS VARCHAR) AS description, CAST(CAST(quantity AS BIGINT) AS VARCHAR) AS quantity, CASE WHEN part % 7 <> 0 THEN CAST(CAST(trunc(sub_total) AS BIGINT) AS VARCHAR) END AS total FROM items")
def pipe_table_items(spark, d):
    """Line items, rendered as pipe tables and read back by their headers."""
    shown = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("-"))
    cell = F.concat(F.lit("| "), shown(F.col("part")), F.lit(" | "), shown(F.rint("quantity")), F.lit(" | "), shown(F.when(F.col("part") % 7 != 0, F.col("sub_total"))), F.lit(" |"))
    body = Tables(spark, d).items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", cell.alias("row")))).alias("rows"))
    text = F.concat(F.lit("Invoice\n| Désignation | Qty | Montant |\n|---|---|---|\n"), F.array_join("rows.row", "\n"), F.lit("\nThanks"))
    return table_items(body.select("doc_id", text.alias("text"))).select("doc_id", F.col("row").cast("long").alias("row"), "description", "quantity", "total")


@query("""WITH l AS (SELECT doc_id, i, x, CASE WHEN starts_with(x, '#') THEN 'title' WHEN starts_with(x, '|') OR contains(x, ' | ') THEN 'table' ELSE 'text' END AS kind FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(x) <> ''),
n AS (SELECT *, CASE WHEN kind = 'table' AND lag(kind) OVER w = 'table' THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS frag FROM n)
SELECT doc_id, CAST(frag AS BIGINT) AS fragment, min(kind) AS kind, count(*) AS lines FROM g GROUP BY doc_id, frag""")
def page_fragments(spark, d):
    """Lines in order; neighbouring table lines are one fragment."""
    x = Tables(spark, d).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).where(F.trim("x") != "")
    x = x.withColumn("kind", F.when(F.col("x").startswith("#"), "title").when(F.col("x").startswith("|") | F.contains("x", F.lit(" | ")), "table").otherwise("text"))
    w = W.partitionBy("doc_id").orderBy("i")
    g = x.withColumn("new", F.when((F.col("kind") == "table") & (F.lag("kind").over(w) == "table"), 0).otherwise(1)).withColumn("fragment", F.sum("new").over(w))
    return g.groupBy("doc_id", "fragment").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("lines"))


@query("""SELECT conv_id, right(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 3000) AS context, count(*) AS turns FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def qa_context(spark, d):
    """What a question is answered from: user and assistant turns in order, the last 3000 characters."""
    turns = Tables(spark, d).conversations.where(F.col("role").isin("user", "assistant"))
    g = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("s")))).alias("x"))
    return g.select("conv_id", F.right(F.array_join("x.s", "\n"), F.lit(3000)).alias("context"), F.size("x").cast("long").alias("turns"))


@query("""SELECT doc_id, m AS found, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS m FROM documents) GROUP BY doc_id, m""")
def regex_identifiers(spark, d):
    found = F.explode(F.regexp_extract_all("text", F.lit("[0-9]{3}-[0-9]{4}"), F.lit(0)))
    return Tables(spark, d).documents.select("doc_id", found.alias("found")).groupBy("doc_id", "found").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, CASE WHEN length(trim(text)) < 10 OR type = 'other' THEN 'unknown' ELSE type END AS type, confidence FROM ({_weighted_sql(0.3)}) JOIN documents USING (doc_id)")
def document_classify(spark, d):
    return classify_documents(Tables(spark, d).documents.select("doc_id", "text"))


def _driver_sql() -> str:
    pages = "SELECT doc_id * 1000 + i AS doc_id, substr(text, i * 2000 + 1, 2000) AS text FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS i FROM documents)"
    body = _weighted_sql(0.2, "parts")
    return f"""WITH parts AS ({pages}), typed AS ({body}), c AS (SELECT doc_id // 1000 AS doc_id, type, count(*) AS n FROM typed GROUP BY ALL),
b AS (SELECT doc_id, arg_min(type, concat(lpad(CAST(100000 - n AS VARCHAR), 6, '0'), type)) AS type, max(n) / CAST(sum(n) AS DOUBLE) AS share FROM c GROUP BY doc_id) SELECT doc_id, type, round(share, 6) AS share, CASE WHEN share < 0.6 THEN 'mixed' ELSE 'uniform' END AS kind FROM b"""


@query(_driver_sql())
def classifier_driver(spark, d):
    """Every page of 2000 characters is classified, then the document by its pages."""
    pages = Tables(spark, d).documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 2000).cast("int") - 1)).alias("page")).where("length(text) > 0")
    typed = document_types(pages.select("doc_id", "page", F.substr("text", F.col("page") * 2000 + 1, F.lit(2000)).alias("text")))
    return typed.withColumn("share", F.round("share", 6))


@query("SELECT doc_id, source, lang AS field, k AS turn FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE lang IS NOT NULL) ORDER BY k, source LIMIT 50")
def example_store(spark, d):
    """At most fifty labelled examples, one of each source in turn."""
    k = F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long")
    return Tables(spark, d).documents.where("lang is not null").select("doc_id", "source", F.col("lang").alias("field"), k.alias("turn")).where("turn <= 50").orderBy("turn", "source").limit(50)


_SIGNED = ", ".join("('" + k + "', [" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "])" for k, (_, ws) in L.PAGE_SIGNATURES.items())


@query(f"""WITH f AS (SELECT doc_id, k, list_filter(ws, lambda w: contains(lower(text), w)) AS ws FROM documents, (VALUES {_SIGNED}) t(k, ws)),
b AS (SELECT doc_id, count(*) AS n_rules, string_agg(concat('- **', k, '**: ', list_aggregate(ws, 'string_agg', '; ')), chr(10) ORDER BY len(ws) DESC, k) AS s FROM f WHERE len(ws) > 0 GROUP BY doc_id)
SELECT doc_id, coalesce(n_rules, 0) AS n_rules, coalesce('### Field Extraction Rules' || chr(10) || s, '') AS prompt FROM documents LEFT JOIN b USING (doc_id)""")
def rules_prompt(spark, d):
    """For each document the rules with a word in its text, those with most words first, as a block of a prompt; none: empty.
    The rules are literals, so a text is read once, in its row, and isn't shuffled."""
    low = Tables(spark, d).documents.select("doc_id", F.lower("text").alias("low"))
    hits = lambda ws: F.array_compact(F.array(*[F.when(F.contains("low", F.lit(w)), F.lit(w)) for w in ws]))
    rules = low.select("doc_id", F.array(*[F.struct(F.lit(k).alias("k"), hits(ws).alias("ws")) for k, (_, ws) in L.PAGE_SIGNATURES.items()]).alias("rules"))
    keyed = F.transform(F.filter("rules", lambda r: F.size(r["ws"]) > 0), lambda r: F.struct((-F.size(r["ws"])).alias("n"), r["k"].alias("k"), F.concat(F.lit("- **"), r["k"], F.lit("**: "), F.array_join(r["ws"], "; ")).alias("s")))
    found = rules.select("doc_id", F.array_sort(keyed)["s"].alias("lines"))
    return found.select("doc_id", F.size("lines").cast("long").alias("n_rules"), F.when(F.size("lines") > 0, F.concat(F.lit("### Field Extraction Rules\n"), F.array_join("lines", "\n"))).otherwise("").alias("prompt"))
