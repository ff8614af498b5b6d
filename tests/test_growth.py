"""Queries whose shuffle, memory or time would outgrow the input: what is shuffled, and the same rows in blocks of any size."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ranking as R


def exchanges(df):
    """Keys by which the plan shuffles rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split("), ")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def texts(spark):
    docs = [(i, f"alpha beta{i % 3} gamma{i % 5} word{i} " + "delta " * (i % 4)) for i in range(40)] + [(40, None), (41, "")]
    asked = [(1, "alpha beta1 delta"), (2, "gamma2 gamma3"), (3, "word7 word8 x"), (4, "nothing here")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")


def test_documents_are_scored_in_their_rows_in_blocks_of_any_size(spark):
    docs, asked = texts(spark)
    best = lambda **more: sorted(map(tuple, R.top_k(R.searched(docs, asked, 3, **more), 3, by=("query_id", "via")).withColumn("score", F.round("score", 9)).collect()))
    assert best() == best(asked_at_once=1, cells=1) == best(asked_at_once=2, cells=10)
    assert {r[1] for r in best()} == {1, 2, 3}
    assert [r[2] for r in best() if r[:2] == ("keywords", 2)] == [2, 3, 7]  # ties go to the smaller document
    assert not any("doc_id" in keys for keys in exchanges(R.sparse(docs, asked, 3)))


def test_pages_of_words_are_read_in_their_rows(spark, data):
    from ledgerloom.plans import layouts

    for name in ("ocr_lines", "ocr_cells", "ocr_markdown", "ocr_layout_text", "graph_markdown", "spatial_edges", "kv_pairs", "ocr_running_lines"):
        assert exchanges(getattr(layouts, name)(spark, data)) == [], name


def test_field_pages_are_scored_and_traced_in_their_rows(spark, data):
    from ledgerloom.plans import fields

    for name in ("field_confidence", "page_confidence_mean", "correction_hint", "traceability_status", "traceability_report"):
        assert not any("page" in keys or "field" in keys for keys in exchanges(getattr(fields, name)(spark, data))), name


def test_large_tables_are_dealt_to_partitions_of_a_bounded_size(spark):
    from ledgerloom.sources.tables import dealt

    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert dealt(rows, "k", size=10).rdd.getNumPartitions() == 100 and dealt(rows, "k", size=10).count() == 1000
    assert dealt(rows, "k") is rows


def test_pipe_tables_are_read_in_the_row_of_their_text(spark, data):
    from ledgerloom.operators.pipe_tables import table_items
    from ledgerloom.plans import texts as queries

    head = "| Article | Qty | Total | Total |\n|---|---|---|---|\n"
    small = "|a|b|\n|-|\n" + f"no\n{head}| x | 1 | 2 | - |\n| | | | |\n |y|-|\nno\n\n{head}no\n| Qty | Total |\n|---|---|\n| 1 | 2 |\nno\n{head}| z |"
    docs = spark.createDataFrame([(1, small), (2, head + "\n".join(f"| a{i} | {i} |" for i in range(50_000))), (3, None), (4, "")], "doc_id long, text string")
    got = table_items(docs)
    assert exchanges(got) == []
    assert [tuple(r) for r in got.where("doc_id = 1").select("table", "row", "description", "quantity", "total").orderBy("table", "row").collect()] == [(0, 0, "x", "1", None), (0, 2, "y", None, None), (4, 0, "z", None, None)]
    assert [tuple(r) for r in got.where("doc_id = 2").selectExpr("count(*)", "max(row)", "sum(int(quantity))", "max(table)").collect()] == [(50_000, 49_999, 1_249_975_000, -1)]
    assert len(exchanges(queries.pipe_table_items(spark, data))) == 1


def test_items_without_values_or_with_parts_of_units_are_those_of_the_twin(spark, tmp_path):
    import duckdb

    from ledgerloom import registry

    from .compare import rows

    lines = [(1, None, 1, 1, 2.0, 10.0, 0.0, 0.0), (1, 5, 1, 2, None, None, 0.0, 0.0), (1, 6, 1, None, 2.5, 10.9, 0.1, 0.0), (2, 14, 1, 1, 3.5, 9.0, 0.0, None), (2, 14, None, 1, 0.4, 9.0, 0.0, 0.0), (2, None, None, 1, None, None, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    registry.load()
    assert rows(registry.QUERIES["pipe_table_items"](spark, str(tmp_path)).toPandas()) == rows(con.sql(registry.ORACLES["pipe_table_items"]).df())


def test_names_a_few_characters_apart_meet_by_keys(spark, monkeypatch):
    import random

    import numpy as np

    from ledgerloom.operators import deletions as D
    from ledgerloom.operators import linking as A
    from ledgerloom.operators.entities import ENTITY, candidates, indel_ratio

    r = random.Random(5)
    names = ["a", "ab", "abc", "abcd", "x" * 39, "x" * 40, "x" * 41, "x" * 42, "x" * 43 + "y" * 30, "x" * 43 + "y" * 33, "\U0001f600 café", "café"]
    while len(names) < 260:
        text = list(r.choice(names[-60:] + ["berg muller", "supplier 000123456", "un qui then"]))
        for _ in range(r.randint(1, 4)):
            k = r.randrange(len(text) + 1)
            text[k : k + r.randint(0, 1)] = r.choice(["", "a", "n", "7", "é"])
        names += [x] if (x := " ".join(sorted("".join(text).split()))) and x not in names else []
    want = {}
    for i, a in enumerate(names):
        score = {j: s for j, b in enumerate(names[:i]) if (s := indel_ratio(a, b)) >= ENTITY}
        want |= {(i, j): s for j, s in score.items() if s == max(score.values())}
    open_names = []

    def counted(left, *args, **more):
        open_names.append(left.count())
        return candidates(left, *args, **more)

    monkeypatch.setattr(A, "candidates", counted)
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    assert {(x.id, x.other): x.score for x in A.nearest_earlier(df).collect()} == want
    assert open_names[0] < 0.7 * len(names)  # the others are not compared with all
    block = A.cut(df.selectExpr("id", "name AS form", "0.8D AS low")).toPandas()
    left = D.left_over
    monkeypatch.setattr(D, "left_over", lambda chars, most: [np.minimum(k, k % 5) for k in left(chars, most)])
    colliding = {(i, j) for x in D.pairs_of(D.keys_of(block, 2, 0.8), 2) for i, j in x[["id", "other"]].itertuples(index=False)}
    assert any(indel_ratio(names[i], names[j]) < ENTITY for i, j in colliding)
    told = [(i, j, 0.99) for i, j in sorted(colliding)]  # pairs that hashes make up are found out, and their names compared with all
    monkeypatch.setattr(A, "shared", lambda *_: spark.createDataFrame(told, "id long, other long, score double"))
    assert {(x.id, x.other): x.score for x in A.nearest_earlier(df).collect()} == want


def test_names_of_arrivals_are_taken_without_splitting_texts(spark):
    from types import SimpleNamespace

    from ledgerloom.plans.invoices import _arrivals

    texts = ["", "one", "one two", "one two three", "a  b c", " x y", None, "é\nü ß z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = _arrivals(SimpleNamespace(documents=docs))
    assert "split(" not in got._jdf.queryExecution().executedPlan().toString()
    want = {i: None if t is None else " ".join(t.split(" ")[:2]) for i, t in enumerate(texts)}
    assert {x.id // 3: x.name for x in got.where("id % 3 = 0").collect()} == want
