"""Queries of retrieval: BM25, dense, fusion, keyword overlap, rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import quantised as Q
from ..operators import ranking as R
from ..registry import query
from ..sources.folders import shared
from ..sources.tables import Tables

_WORDS = "list_filter(string_split(regexp_replace(lower(text), '[.,\\n]', ' ', 'g'), ' '), lambda w: length(w) > 1)"
_BM25 = f"""lens AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
tf AS (SELECT doc_id, n, w, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS w FROM lens) GROUP BY doc_id, n, w),
st AS (SELECT CAST(count(*) AS DOUBLE) AS nd, avg(n) AS ml FROM lens), raw AS (SELECT w, ml, ln(nd - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY w, nd, ml),
idf AS (SELECT w, ml, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, w, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_WORDS}) AS w FROM benchmark) GROUP BY query_id, w),
bm AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / ml))) AS score FROM q JOIN idf USING (w) JOIN tf USING (w) GROUP BY query_id, doc_id)"""


def _searched(t: Tables, k: int):
    return R.searched(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text"), k)


@query(f"""WITH {_BM25} SELECT query_id, rank, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 5""")
def bm25_topk(spark, d):
    return R.top_k(_searched(Tables(spark, d), 5).where("via = 'bm25'"), 5).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


_DENSE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
dense AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_dot_product(q.a, v.a) / (sqrt(list_dot_product(q.a, q.a)) * sqrt(list_dot_product(v.a, v.a))) AS score FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)"""


def _dense(t: Tables, k: int):
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return R.dense(v, v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), k)


@query(f"WITH {_DENSE} SELECT query_id, rank, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dense) WHERE rank <= 5")
def dense_topk(spark, d):
    return R.top_k(_dense(Tables(spark, d), 5), 5).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


_TOP = "SELECT query_id, rank, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dense) WHERE rank <= 5"


@query(f"WITH {_DENSE} {_TOP}")
def quantised_topk(spark, d):
    """What `dense_topk` finds, from 4-bit codes and the vectors of those that may be among the best."""
    v = Tables(spark, d).embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    index = Q.VectorIndex(spark, f"{shared(spark)}/vectors-{uuid.uuid4().hex}")
    index.refresh(v)
    found = Q.search(index.codes(), v, v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), 5)
    return R.top_k(found, 5).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


_BUCKET = "CAST(concat('0x', left(md5(CAST(vec_id AS VARCHAR)), 6)) AS BIGINT) % 64"


@query(f"""WITH v AS (SELECT vec_id, len(embedding) AS size, {_BUCKET} AS bucket FROM embeddings), r AS (SELECT 1 AS run, *, true AS new FROM v WHERE vec_id % 1000 >= 3 UNION ALL
  SELECT 2, *, bucket IN (SELECT bucket FROM v WHERE vec_id % 1000 < 3) FROM v UNION ALL SELECT 3, *, false FROM v UNION ALL SELECT 4, *, bucket IN (SELECT bucket FROM v WHERE vec_id % 1000 = 500) FROM v)
SELECT run, count(*) AS vectors, count(DISTINCT bucket) FILTER (new) AS buckets_written, CAST(sum((size + 1) // 2 + 16) AS BIGINT) AS bytes_scanned, CAST(sum(size * 4) AS BIGINT) AS bytes_of_vectors FROM r GROUP BY run""")
def quantised_index_runs(spark, d):
    """An index brought up to date four times: some vectors missing, all there, nothing new, some vectors turned round."""
    v = Tables(spark, d).embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    turned = F.when(F.col("doc_id") % 1000 == 500, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    index = Q.VectorIndex(spark, f"{shared(spark)}/vectors-{uuid.uuid4().hex}")
    out = None
    for run, rows in enumerate([v.where("doc_id % 1000 >= 3"), v, v, v.withColumn("embedding", turned)], 1):
        written = len(index.refresh(rows))
        size = index.codes().agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.length("code") + 16).alias("bytes_scanned"))
        plain = rows.where(Q.usable()).agg(F.sum(F.size("embedding") * 4).cast("long").alias("bytes_of_vectors"))
        row = size.crossJoin(plain).select(F.lit(run).alias("run"), "vectors", F.lit(written).alias("buckets_written"), "bytes_scanned", "bytes_of_vectors")  # one row each
        out = row if out is None else out.union(row)
    return out


_OVER = f"""ov AS (SELECT query_id, doc_id, CAST(sum(2) AS DOUBLE) AS score FROM (SELECT DISTINCT query_id, w FROM q WHERE length(w) > 3) JOIN (SELECT DISTINCT doc_id, w FROM tf) USING (w) GROUP BY query_id, doc_id)"""


@query(f"WITH {_BM25}, {_OVER} SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ov) WHERE rank <= 5")
def keyword_overlap_topk(spark, d):
    return R.top_k(_searched(Tables(spark, d), 5).where("via = 'keywords'"), 5).select("query_id", "rank", "doc_id", "score")


@query(f"""WITH {_BM25}, {_OVER}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 10),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ov) WHERE rank <= 10),
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank - 1)) AS score FROM (SELECT query_id, doc_id, rank FROM a UNION ALL SELECT query_id, doc_id, rank FROM b) GROUP BY query_id, doc_id)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) WHERE rank <= 5""")
def rrf_topk(spark, d):
    both = R.fused(R.top_k(_searched(Tables(spark, d), 10), 10, by=("query_id", "via")))
    return R.top_k(both, 5).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


_RULES = [(i, k, " ".join(ws)) for i, (k, (_, ws)) in enumerate(L.PAGE_SIGNATURES.items())]
_RULE_SQL = ", ".join(f"({i}, '{k}', '{w}')" for i, k, w in _RULES)


@query(f"""WITH r AS (SELECT * FROM (VALUES {_RULE_SQL}) x(pos, rule, body)), w AS (SELECT page_id, unnest(string_split(lower(url), '/')) AS w FROM pages),
s AS (SELECT page_id, rule, pos, CAST(coalesce(sum(CASE WHEN length(w) > 3 AND contains(body, w) THEN 1 ELSE 0 END), 0) AS BIGINT) AS score FROM w, r GROUP BY page_id, rule, pos)
SELECT page_id, rank, rule, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM s) WHERE rank <= 2""")
def rules_topk(spark, d):
    """Every rule is scored on every page; the rules are a handful of literals, so the page stays in its row."""
    words = F.filter(F.split(F.lower("url"), "/"), lambda w: F.length(w) > 3)
    scored = F.array(*[F.struct(F.size(F.filter(words, lambda w, b=b: F.contains(F.lit(b), w))).cast("long").alias("score"), F.lit(-i).alias("pos"), F.lit(k).alias("rule")) for i, k, b in _RULES])
    best = Tables(spark, d).pages.select("page_id", F.slice(F.sort_array(scored, asc=False), 1, 2).alias("best"))
    return best.select("page_id", F.posexplode("best").alias("rank", "b")).select("page_id", (F.col("rank") + 1).alias("rank"), "b.rule", "b.score")


@query(f"""WITH {_BM25}, {_OVER}, s AS (SELECT *, 'bm25' AS via FROM bm WHERE score > 0 UNION ALL SELECT query_id, doc_id, score, 'keywords' FROM ov WHERE query_id NOT IN (SELECT query_id FROM bm WHERE score > 0))
SELECT query_id, rank, doc_id, round(score, 4) AS score, via FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def retrieval_sparse(spark, d):
    """BM25, and common words for queries that it finds nothing for."""
    t = Tables(spark, d)
    found = R.sparse(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 3)
    return R.retrieved("sparse", 3, None, found).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"), "via")
