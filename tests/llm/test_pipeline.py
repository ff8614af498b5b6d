"""The pipeline on a small table, and the SQL twins of the training-data queries."""

import pytest

from ledgerloom.llm import queries

from ..compare import connect, rows


def test_each_stage_acts_on_what_the_one_before_kept(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, data))
        assert docs.columns == columns, name
    last = p.STAGES[-1][1](spark, docs, data)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(last) == ids(docs) and docs.where("text like '%@mail%'").count() == 0
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "pii", "mixing", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, data, name):
    assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(connect(data).sql(queries.ORACLES[name]).df())
