"""State that outlives a run: vendor history, result cache, repeated extraction, and the language model."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as L
from ledgerloom.operators import language as LG
from ledgerloom.operators import retry as RE
from ledgerloom.sources.cache import ResultCache, through
from ledgerloom.streaming import history as H
from ledgerloom.streaming import progress as P

ORDERS = "doc_id long, vendor_id long, invoice_date date, total double"


def test_history_goes_on_from_its_checkpoint_and_forgets(spark, tmp_path):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    first = [(i, 1, day(i), 100.0 + i % 3) for i in range(8)] + [(50, 2, day(0), 5.0), (51, None, day(0), None)]
    second = [(8, 1, day(40), 101.0), (9, 1, day(41), 9999.0), (10, 1, day(42), 101.0), (52, 2, day(300), 5.0), (53, 3, None, 1.0)]
    third = [(11, 1, day(2000), 101.0), (60, 4, day(2000), 1.0)]
    fourth = [(12, 1, day(2001), 101.0), (61, 4, day(2001), 1.0)]
    out = None
    for rows in (first, second, third, fourth):
        spark.createDataFrame(rows, ORDERS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders")
        out = H.run_over(spark.readStream.schema(ORDERS).parquet(f"file://{tmp_path}/orders"), f"file://{tmp_path}/state", forget_days=365)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {*range(13), 50, 51, 52, 60, 61}
    assert [got[i].n for i in range(8)] == list(range(8)) and got[7].duplicate_of == 1
    assert got[8].n == 8 and got[8].duplicate_of is None  # 33 days after the last of its total
    assert got[9].anomalous and not got[8].anomalous and got[10].duplicate_of == 8
    assert got[52].n == 1 and got[52].duplicate_of is None and got[51].n == 0
    assert got[12].duplicate_of == 11 and got[61].n == 1


def test_history_of_many_vendors_is_not_checked_vendor_by_vendor(spark, tmp_path):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    many = [(i, i, day(0), 5.0) for i in range(20_000)]
    one = [(90_000 + i, 70_000, day(i // 60), 10.0 + 0.009 * (i % 3)) for i in range(180)] + [(95_000 + i, None, day(0), 7.0) for i in range(2)]
    began = time.monotonic()
    for rows in (many + one[:90], one[90:] + [(i + 30_000, i, day(1), 5.0) for i in range(20_000)]):
        spark.createDataFrame(rows, ORDERS).repartition(4).write.mode("append").parquet(f"{tmp_path}/orders")
        out = H.run_over(spark.readStream.schema(ORDERS).parquet(f"file://{tmp_path}/orders"), f"file://{tmp_path}/state")
    got = {r.doc_id: r for r in out.collect()}
    assert time.monotonic() - began < 60  # a call for each vendor and batch takes longer
    assert len(got) == 40_182 and all(got[i + 30_000].duplicate_of == i and got[i + 30_000].n == 1 for i in range(20_000))
    rows = [r for r in one if r[1]]
    for k, (doc, _, at, total) in enumerate(rows):
        assert got[doc].duplicate_of == min((d for d, _, a, t in rows[:k] if a >= at - dt.timedelta(days=30) and abs(t - total) < 0.01), default=None) and got[doc].n == min(k, 50)
    assert got[95_001].duplicate_of is None and got[95_001].n == 1


def test_breaker_puts_frames_of_a_user_in_order(spark, tmp_path):
    kinds = ["error" if i % 9 else "click" for i in range(400)]
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=i // 2), i % 7 // 6, kinds[i], 1.0) for i in sorted(range(400), key=lambda i: i * 37 % 400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {tuple(r) for r in P.replayed(spark, f"file://{tmp_path}/events", P.breaker_stream).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for user in (0, 1):
        n, was = 0, False
        for i in (i for i in range(400) if i % 7 // 6 == user):
            n = n + 1 if kinds[i] == "error" else 0
            if (n >= 5) != was:
                was = not was
                want.add((user, i, "open" if was else "closed"))
    assert got == want and len(want) > 20


class TestCache:
    def frame(self, spark, rows):
        return spark.createDataFrame(rows, "key string, result string, cached_at string").withColumn("cached_at", F.col("cached_at").cast("timestamp"))

    def test_put_get_expire_clear(self, spark, tmp_path):
        c = ResultCache(spark, f"file://{tmp_path}/c", buckets=4)
        assert c.rows().count() == 0 and c.stats("2024-01-01").first().entries == 0
        c.put(self.frame(spark, [("a", "1", "2024-01-01 00:00:00"), ("a", "2", "2024-01-01 01:00:00"), (None, "x", "2024-01-01 00:00:00"), ("b", "3", "2024-01-01 00:00:00")]))
        c.put(self.frame(spark, [("b", "4", "2024-01-03 00:00:00"), *((f"k{i}", "v", "2024-01-03 00:00:00") for i in range(20))]))
        asked = spark.createDataFrame([("a",), ("b",), ("z",), (None,), ("b",)], "key string")
        got = sorted(((r.key or "", r.result, r.hit) for r in c.get(asked, "2024-01-01 12:00:00").collect()))
        assert got == [("", None, False), ("a", "2", True), ("b", "4", True), ("b", "4", True), ("z", None, False)]
        assert [tuple(r) for r in c.stats("2024-01-03 12:00:00").collect()] == [(22, 1, 22)]
        c.clear("2024-01-03 12:00:00")
        assert "a" not in {r.key for r in c.rows().collect()} and c.rows().count() == 21
        c.put(self.frame(spark, []))
        c.clear()
        assert c.rows().count() == 0
        c.put(self.frame(spark, [("a", "9", "2024-01-05 00:00:00")]))
        assert [r.result for r in c.rows().collect()] == ["9"]

    def test_a_put_that_fails_leaves_the_old_state(self, spark, tmp_path):
        c = ResultCache(spark, f"file://{tmp_path}/c", buckets=4)
        c.put(self.frame(spark, [("a", "1", "2024-01-01 00:00:00")]))
        bad = self.frame(spark, [("a", "2", "2024-01-02 00:00:00"), ("b", "2", "2024-01-02 00:00:00")]).withColumn("result", F.when(F.col("key") == "b", F.raise_error(F.lit("stop"))).otherwise(F.col("result")))
        with pytest.raises(Exception, match="stop"):
            c.put(bad)
        assert [tuple(r)[:2] for r in c.rows().collect()] == [("a", "1")]

    def test_only_missing_keys_are_called_for_once(self, spark, tmp_path):
        c, seen = ResultCache(spark, f"file://{tmp_path}/c", buckets=4), []
        rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, k string")

        def call(keys):
            seen.append(sorted(r.key for r in keys.collect()))
            return keys.withColumn("result", F.upper("key"))

        for k, more in enumerate((rows, rows.union(rows.selectExpr("id + 10", "concat(k, 'x')")), rows)):
            got = through(c, more, "k", call, "2024-01-01").collect()
            assert len(got) == more.count() and all(r.result == (r.k and r.k.upper()) for r in got) and all(r.hit == (r.k is not None and k > 0 and "x" not in r.k) for r in got)
        assert seen == [["a", "b"], ["ax", "bx"], []]


def test_extraction_again_sends_fewer_pages_each_round(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    class Mends:
        def generate(self, prompts):
            for p in prompts:
                (log / p.replace(" ", "_").replace("/", "_")).touch()
            return [json.dumps({"mended": 1}) for _ in prompts]

        def embed(self, texts):
            raise NotImplementedError

    def score(pages):
        mended = F.col("mended_then") + F.coalesce(F.get_json_object("answer", "$.mended").cast("int"), F.lit(0))
        left = F.greatest(F.lit(0), F.col("errors") - mended)
        return pages.withColumns({"confidence": 1.0 - 0.2 * left, "hint": F.when(F.col("id") != 5, F.concat_ws(" ", F.lit("page"), "id", left.cast("string"))), "mended_then": mended})

    pages = spark.createDataFrame([(i, i % 5, 0) for i in range(10)] + [(20, None, 0)], "id long, errors int, mended_then int")
    got = {r.id: (r.rounds, round(r.confidence or 0, 2)) for r in RE.again(pages, Mends(), score).collect()}
    assert got == {0: (0, 1.0), 1: (0, 0.8), 2: (1, 0.8), 3: (2, 0.8), 4: (2, 0.6), 5: (0, 1.0), 6: (0, 0.8), 7: (1, 0.8), 8: (2, 0.8), 9: (2, 0.6), 20: (0, 1.0)}
    assert len(list(log.iterdir())) == 6 + 4
    assert RE.again(pages.limit(0), Mends(), score).count() == 0


class TestLanguage:
    def test_held_out_documents_are_told_apart(self, spark, data):
        from ledgerloom import registry

        registry.load()
        rows = registry.QUERIES["language_model"](spark, data.replace("sf0.001", "sf0.01")).where("held_out and lang is not null").collect()
        long = [r for r in rows]
        assert len(long) > 100 and sum(r.language == r.lang for r in long) >= 0.95 * len(long)

    def test_odd_texts(self, spark):
        train = spark.createDataFrame([("le chat est sur la table et il dort", "fr"), ("the cat is on the table and sleeps", "en"), (None, "xx"), ("nothing", None), ("ab", "yy")], "text string, lang string")
        model = LG.learned(train)
        assert set(model) == {"fr", "en"} | ({"yy"} & set(model))
        rows = spark.createDataFrame([(0, None), (1, ""), (2, "la table"), (3, "est-ce que le chat dort sur la table"), (4, "is the cat on the table now or not"), (5, "🙂" * 30)], "id long, text string")
        got = {r.id: r.language for r in LG.detected(rows, model).collect()}
        assert got[0] == got[1] == got[2] == "en" and got[3] == "fr" and got[4] == "en" and got[5] in model
        assert {r.language for r in LG.detected(rows, {}).collect()} == {"en"}
        assert LG.detected(rows.limit(0), model).count() == 0

    def test_keyword_lists(self):
        assert len(L.FRENCH_KEYWORDS) > 60 and "montant" in L.FRENCH_KEYWORDS and "the" in L.ENGLISH_KEYWORDS
