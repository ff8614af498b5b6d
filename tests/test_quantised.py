"""The index of 4-bit codes against a full search, its buckets, and odd vectors."""

import numpy as np
import pytest

from ledgerloom.operators import quantised as Q
from ledgerloom.operators import ranking as R


def made(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in r] if r is not None else None) for i, r in enumerate(x)], "doc_id long, embedding array<float>")


def best(found, k):
    return {(r.query_id, r.rank): r.doc_id for r in R.top_k(found, k).collect()}


@pytest.mark.parametrize("size", [7, 32])
@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_finds_what_a_full_search_finds(spark, size, shift):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(600, size)) + shift
    x[100:140] = x[100]  # ties
    v = made(spark, x)
    q = v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    codes = Q.encoded(v)
    assert codes.count() == 600 and codes.first().code and len(codes.first().code) == (size + 1) // 2
    want = best(R.dense(v, q, 5), 5)
    for block, at_once in ((8_192, 512), (100, 7)):
        assert best(Q.search(codes, v, q, 5, block, at_once), 5) == want


def test_codes_leave_most_vectors_of_a_clustered_table_unread(spark):
    rnd = np.random.default_rng(6)
    x = np.repeat(rnd.normal(size=(50, 64)), 40, axis=0) + rnd.normal(size=(2000, 64)) * 0.1
    v = made(spark, x)
    q = v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    assert Q.candidates(Q.encoded(v), q, 5).count() < 20 * 2000 * 0.05


def test_fewer_vectors_than_asked_for(spark):
    v = made(spark, [[1, 0], [0, 1], [-1, 0]])
    found = Q.search(Q.encoded(v), v, v.withColumnRenamed("doc_id", "query_id"), 5)
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    v = made(spark, [[1, 0], None, [0, 0], [nan, 1], [inf, 1], [1, 1], [1e-30, 0]])
    v = v.union(spark.createDataFrame([(7, [None, 1.0]), (8, [])], v.schema))
    assert {r.doc_id for r in Q.encoded(v).collect()} == {0, 5, 6}
    found = Q.search(Q.encoded(v), v, v.withColumnRenamed("doc_id", "query_id"), 5)
    assert {r.query_id for r in found.collect()} == {0, 5, 6}
    none = v.where("false")
    assert Q.search(Q.encoded(none), none, none.withColumnRenamed("doc_id", "query_id"), 5).count() == 0


def test_only_changed_buckets_are_written(spark, tmp_path):
    rnd = np.random.default_rng(7)
    v = made(spark, rnd.normal(size=(100, 8)))
    index = Q.VectorIndex(spark, f"file://{tmp_path}/i", buckets=8)
    assert index.codes().count() == 0
    assert index.refresh(v) == list(range(8)) and index.codes().count() == 100
    assert index.refresh(v) == []
    less = v.where("doc_id <> 5")
    assert len(index.refresh(less)) == 1 and index.codes().count() == 99
    mended = less.union(made(spark, [[1.0] * 8], first=5))
    assert len(index.refresh(mended)) == 1
    same = {r.doc_id: (bytes(r.code), r.scale) for r in Q.encoded(mended).collect()}
    assert {r.doc_id: (bytes(r.code), r.scale) for r in index.codes().collect()} == same
    assert index.refresh(v.where("false")) == list(range(8)) and index.codes().count() == 0


def test_a_refresh_that_fails_leaves_the_old_state(spark, tmp_path):
    v = made(spark, [[1.0, 2.0], [2.0, 1.0]])
    index = Q.VectorIndex(spark, f"file://{tmp_path}/i", buckets=2)
    index.refresh(v)
    ragged = v.union(made(spark, [[1.0, 2.0, 3.0], [4.0]] * 4, first=2))
    with pytest.raises(Exception):
        index.refresh(ragged.coalesce(1))
    assert {r.doc_id for r in index.codes().collect()} == {0, 1}
