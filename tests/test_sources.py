"""Files, names and providers on small inputs."""

import json
import random

import pytest

from ledgerloom.operators import entities as E
from ledgerloom.providers import StandIn, embedded, generated
from ledgerloom.sources import files


def test_scan_decode_and_refusal(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.txt").write_bytes("héllo".encode("latin-1"))
    (tmp_path / "c.exe").write_bytes(b"x")
    found = files.scan(spark, str(tmp_path))
    assert {r.path.rpartition("/")[2]: r.refused for r in found.collect()} == {"a.txt": None, "b.txt": None, "c.exe": "unsupported suffix"}
    assert {r.text for r in files.text_documents(found).collect()} == {"héllo"}


def test_annotations(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("text,left,top,width,height,label\n FA-1 ,10,20,100,30,NUMBER\n5,1,2,3,4,\n")
    rows = files.annotations(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.text, r.label, r.box) for r in rows] == [("FA-1", "NUMBER", [10, 20, 110, 50]), ("5", "O", [1, 2, 4, 6])]
    assert [(r.label, len(r.found)) for r in files.label_lists(files.annotations(spark, str(tmp_path))).collect()] == [("NUMBER", 1)]


def test_corrections(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"document_type": "", "message": "m1"}, {"document_type": "invoice", "correction": "c2"}, {"document_type": "contract", "correction": "c3"}]))
    assert [r[0] for r in files.corrections(spark, str(tmp_path / "c.json"), "invoice").collect()] == ["m1", "c2"]
    fields = spark.createDataFrame([("d", p, "TOTAL", "1") for p in (1, 2)], "doc_id string, page int, field string, value string")
    changes = spark.createDataFrame([("d", "TOTAL", "5"), ("d", "p2__TOTAL", "7")], "doc_id string, key string, value string")
    assert {r.page: r.value for r in files.apply_corrections(fields, changes).collect()} == {1: "5", 2: "7"}


def test_names(spark):
    assert E.indel_ratio("abcd", "abxd") == pytest.approx(0.75) and E.indel_ratio("", "") == 1.0
    left = spark.createDataFrame([(1, "DUPONT Martin SARL"), (2, "Unknown"), (3, None)], "id long, name string")
    right = spark.createDataFrame([(8, "Martin Dupont SARL"), (7, "Dupond Martine"), (6, None)], "vendor_id long, vendor string")
    assert [tuple(r) for r in E.best_vendor(left, right).collect()] == [(1, 8, 1.0)]
    names = spark.createDataFrame([(1, "acme tools"), (2, "acme tool"), (3, "acne tool"), (9, "zeta")], "id long, name string")
    assert {r.id: r.entity for r in E.entities(names).collect()} == {1: 1, 2: 1, 3: 1, 9: 9}


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_no_similar_pair_is_lost(spark, least):
    r = random.Random(7)
    names = ["Bosch", "Dosch", "Acmecorporation", "Bcmecorporation", "SA", "sa Ltd", "the co", "", "  ", "x", "y"]
    names += ["".join(r.choice("abcde ") for _ in range(r.randint(1, 14))) for _ in range(90)]
    d = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {(p.id, p.other) for p in E.likely_same(d, least).collect()}
    ready = [" ".join(sorted(n.lower().split())) for n in names]
    assert got == {(i, j) for j in range(len(names)) for i in range(j) if E.indel_ratio(ready[i], ready[j]) >= least}
    best = {(b.id, b.vendor_id) for b in E.best_vendor(d.where("id % 2 = 0"), d.where("id % 2 = 1").withColumnsRenamed({"id": "vendor_id", "name": "vendor"}), least).collect()}
    scores = {i: max((E.indel_ratio(ready[i], ready[j]), -j) for j in range(1, len(names), 2)) for i in range(0, len(names), 2)}
    assert best == {(i, -j) for i, (score, j) in scores.items() if score >= least}


def test_running_lines_hold_all_words_of_a_long_text(spark, tmp_path):
    from ledgerloom.plans.layouts import ocr_running_lines

    texts = [(1, " ".join(f"w{i}" for i in range(450))), (2, "a\nb c"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.page, r.line, r.y, r.n) for r in ocr_running_lines(spark, str(tmp_path)).collect())
    y = lambda line: 20.0 * line + 50.0 * (line // 5)  # noqa: E731  (the table of words leaves a gap after every fifth line)
    assert got == [(1, i // 20, i % 20, y(i % 20), 10) for i in range(45)] + [(2, 0, 0, 0.0, 3)]


def test_providers(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, None)], "id int, prompt string")
    got = {r.id: r.answer for r in generated(rows, StandIn()).collect()}
    assert got[1] == got[2] == StandIn().generate(["p"])[0] and got[3] is None
    v = embedded(spark.createDataFrame([("a b",), (None,)], "text string"), StandIn(8)).collect()
    assert sum(x * x for x in v[0].embedding) == pytest.approx(1, abs=1e-6) and sum(v[1].embedding) == 0
