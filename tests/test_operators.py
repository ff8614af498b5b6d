"""Small tables with exact expectations, nulls and odd values among them."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as X
from ledgerloom.operators import rules as R
from ledgerloom.operators.chunks import cut_points, fixed_chunks, sentence_chunks
from ledgerloom.operators.exports import edi_810, ubl_invoice
from ledgerloom.operators.pipe_tables import table_items
from ledgerloom.operators.steps import available, downstream
from ledgerloom.plans.ask import route


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


STRINGS = ["1.234,56", "1,234.56", "1.234,56 €", "$1,234.56", "100,00 €", "42", "", None, "1d", "1,234"]


@pytest.mark.parametrize(("parser", "expected"), [
    (N.parse_simple, [None, None, None, None, 100.0, 42.0, None, None, None, 1.234]),
    (N.parse_broad, [1234.56, 1234.56, 1234.56, 1234.56, 100.0, 42.0, None, None, None, 1.234]),
    (N.parse_careful, [1234.56, 1234.56, 1234.56, 1234.56, 100.0, 42.0, None, None, None, 1234.0]),
    (N.parse_plain, [None, None, None, None, None, 42.0, None, None, None, 1.234]),
    (N.parse_or_zero, [0.0, 0.0, 0.0, 0.0, 100.0, 42.0, 0.0, 0.0, 0.0, 1.234]),
])
def test_number_parsers_differ_as_documented(spark, parser, expected):
    assert values(spark, parser, STRINGS) == expected


def test_normal_forms(spark):
    assert values(spark, N.normal_number, ["100.", "1.200", "€ 1 000,50", "7", None]) == ["100", "1.2", "1000.5", "7", None]
    assert values(spark, X.fold, ["  Élan €5 ", None, "ß"]) == ["elan 5", None, ""]
    assert values(spark, X.iban_ok, ["GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "x", None]) == [True, False, False, False]
    assert [str(d) for d in values(spark, lambda c: X.first_date(c, X.DAY_FIRST), ["03/04/2024", "2024-04-03", "13/13/2024", None])] == ["2024-04-03", "2024-04-03", "None", "None"]


def test_token_f1_and_jaccard(spark):
    df = spark.createDataFrame([("Total", "total"), ("abc", "abd"), ("a b", "a c"), ("", "")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(X.token_f1(F.col("a"), F.col("b"))).collect()] == [1.0, 0.667, 0.5, 1.0]
    assert [r[0] for r in df.select(X.jaccard(X.tokens(F.col("a")), X.tokens(F.col("b")))).collect()][2:] == [pytest.approx(1 / 3), 0.0]


def test_markdown_and_pipe_tables(spark):
    text = "# Invoice\n\n| Désignation | Qté | Montant |\n|---|---|---|\n| Bolt | 2 | 10 |\n| Nut | - | 5 |\n| |  | |\nend\n| a | b |\n| c | d |"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.row, r.description, r.quantity, r.total) for r in table_items(df).orderBy("row").collect()]
    assert got == [(1, 0, "Bolt", "2", "10"), (1, 1, "Nut", None, "5")]
    assert values(spark, X.strip_markdown, ["# A\n\n| x | y |\n|---|---|\nplain"]) == ["# A\nx  y\nplain"]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 1700), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.chunk, len(r.content)) for r in fixed_chunks(df).orderBy("chunk").collect()] == [(1, 0, 1000), (1, 1, 900), (1, 2, 100)]
    assert cut_points("a" * 900 + ". " + "b" * 600)[0] == (0, 901)
    assert {r.total for r in sentence_chunks(df.where("doc_id = 1")).collect()} == {2}


def test_rules(spark):
    rows = [(1, 10.0, 10.0, 10.5, 1, 5.0), (2, -5.0, 10.0, 9.0, 1, 5.0), (3, 10.0, None, None, 0, 5.0)]
    inv = spark.createDataFrame(rows, "doc_id long, total double, net double, gross double, n_lines long, expected_vat double")
    got = {r.doc_id: ([i["rule"] for i in r.issues], r.errors, r.is_valid) for r in R.issue_counts(R.invoice_issues(inv)).collect()}
    assert got[1] == ([], 0, True)
    assert got[2] == (["arithmetic", "vat_context", "arithmetic", "ranges"], 2, False)
    assert got[3] == (["required_fields"], 1, False)


def test_exports_escape_and_count_segments(spark):
    items = [{"pos": 1, "description": "A & B", "quantity": 2.0, "unit_price": 1.5, "sub_total": 3.0}]
    df = spark.createDataFrame([(7, "X < Y", "2024-01-02", 3.0, items), (8, None, "2024-01-02", 1.0, None)], "doc_id long, supplier string, invoice_date string, total double, items array<struct<pos:bigint,description:string,quantity:double,unit_price:double,sub_total:double>>")
    df = df.withColumn("invoice_date", F.to_date("invoice_date"))
    xml = [r[0] for r in df.orderBy("doc_id").select(ubl_invoice()).collect()]
    assert "A &amp; B" in xml[0] and "X &lt; Y" in xml[0] and "InvoiceLine" not in xml[1]
    edi = [r[0].split("\n") for r in df.orderBy("doc_id").select(edi_810()).collect()]
    assert "SE*6*0001~" in edi[0] and "SE*5*0001~" in edi[1] and edi[1][4] == "N1*SU*SUPPLIER~"


def test_steps_and_routes(spark):
    assert ("ingestion", "evaluation") in {tuple(r) for r in downstream(spark).collect()}
    assert [r.step for r in available(spark, ["ingestion", "ocr", "embedding", "document_classifier"], ["ingestion"]).orderBy("place").collect()] == ["ocr", "document_classifier"]
    assert [route(q) for q in ("Which vendor?", "Quel est le montant?", "hello", "What dates?")] == ["suppliers", "financial", "overview", "dates"]


def test_filters_and_columns_reach_the_scan(spark, data):
    from ledgerloom.sources.tables import Tables

    plan = Tables(spark, data).orders.where("o_orderstatus = 'O'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "o_totalprice" not in plan


def test_layout_of_a_small_page(spark):
    from ledgerloom.operators import layout as P

    box = lambda pos, word, x, y: (1, 0, pos, word, x, y, x + 8 * len(word), y + 16)
    rows = [box(0, "Invoice", 0, 0), box(1, "no", 60, 2), box(2, "Item", 0, 80), box(3, "Qty", 200, 80), box(4, "Bolt", 0, 100), box(5, "2", 200, 101), box(6, "Nut", 0, 120), box(7, "3", 200, 120), box(8, "Cog", 0, 140), box(9, "4", 200, 140), box(10, "Total:", 0, 240), box(11, "9", 60, 240)]
    words = spark.createDataFrame(rows, "doc_id long, page long, pos int, word string, x0 long, y0 long, x1 long, y1 long")
    lines = [(r.content, r.cells, r.section) for r in P.text_lines(words).orderBy("line").collect()]
    assert lines == [("Invoice no", 1, 0), ("Item | Qty", 2, 1), ("Bolt | 2", 2, 1), ("Nut | 3", 2, 1), ("Cog | 4", 2, 1), ("Total: 9", 1, 2)]
    assert P.page_markdown(words).first().markdown == "## Invoice no\n\n| **Item** | **Qty** |\n|---|---|\n| Bolt | 2 |\n| Nut | 3 |\n| Cog | 4 |\n\nTotal: 9\n"
    assert [(r.label, r.value) for r in P.key_values(words, ["total", "invoice"]).orderBy("pos").collect()] == [("invoice", None), ("total", "9")]
    found = P.value_spans(words, spark.createDataFrame([(1, "bolt 2"), (1, "total: 8"), (1, ""), (2, "bolt")], "doc_id long, value string")).collect()
    assert [(r.value, r.pos, r.x0, r.y0, r.x1, r.y1) for r in found] == [("bolt 2", 4, 0, 100, 208, 117)]
    brute = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            kind = "below" if abs(a[5] - b[5]) / 600 > 0.02 else "same_column" if abs(a[4] - b[4]) / 800 < 0.015 else "right_of"
            brute[kind] = brute.get(kind, 0) + 1
    assert {r.relation: r.n for r in P.spatial_relations(words).collect()} == brute
    assert P.text_lines(words.limit(0)).count() == 0 and P.spatial_relations(words.limit(0)).count() == 0


def test_fields_with_nulls_and_empty_tables(spark):
    from ledgerloom.operators import fields as O

    fields = spark.createDataFrame([(1, 1, "TOTAL", "-5"), (1, 1, "SUPPLIER", "null"), (1, 2, "SUPPLIER_NAME", " Acme "), (1, 2, "TOTAL", None), (2, 1, None, "x")], "doc_id long, page long, field string, value string")
    issues = spark.createDataFrame([(1, 1, "negative", "error", "Negative total", ["TOTAL"]), (1, 1, "format", "warning", "Odd", ["TOTAL", "X"])], "doc_id long, page long, rule string, severity string, message string, fields array<string>")
    scores = {(r.page, r.field): (r.confidence, r.level) for r in O.field_scores(fields.where("doc_id = 1"), issues, F.lit(True)).collect()}
    assert scores == {(1, "TOTAL"): (0.55, "low"), (1, "SUPPLIER"): (0.0, "low"), (2, "SUPPLIER_NAME"): (1.0, "high"), (2, "TOTAL"): (0.0, "low")}
    assert [(r.page, r.supplier) for r in O.linked_entities(fields, ["SUPPLIER", "SUPPLIER_NAME"]).collect()] == [(2, "Acme")]
    assert {(r.page, r.field, r.status) for r in O.traces(fields.where("doc_id = 1"), issues).collect()} == {(1, "TOTAL", "WARNING"), (1, "SUPPLIER", "VALID"), (2, "SUPPLIER_NAME", "VALID"), (2, "TOTAL", "VALID")}
    assert O.gathered(fields.where("doc_id = 1")).first().text == "[Page 1]\n  TOTAL: -5\n\n[Page 2]\n  SUPPLIER_NAME:  Acme "
    assert O.correction_hints(issues, spark.createDataFrame([(1, 2, "TOTAL", 0.1)], "doc_id long, page long, field string, confidence double")).orderBy("page").first().hint == "Odd Negative total"
    for made in (O.gathered(fields.limit(0)), O.results_json(fields.limit(0), issues.limit(0)), O.graph_stats(O.graph_nodes(fields.limit(0))), O.label_sets(fields.limit(0), fields.limit(0))):
        assert made.count() == 0


def test_transcripts_merge(spark):
    from ledgerloom.operators.fields import merged_transcripts

    rows = [(["Tota1", "12", "EUR"], ["total", "12", "eur", "net"], [0.5, 0.9, None]), (["a", "b", "c", "d", "e"], ["a"], [0.1] * 5), ([], ["x"], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, c array<double>")
    got = [[tuple(x) for x in r[0]] for r in df.select(merged_transcripts(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got[0] == [("Tota1", 0.5), ("12", 0.9), ("EUR", 0.5), ("total", 0.95), ("12", 0.95), ("eur", 0.95), ("net", 0.95)]
    assert got[1] == [(w, 0.1) for w in "abcde"] and got[2] == [("x", 0.95)]


def test_rare_words_lose_no_pair(spark):
    import random

    from ledgerloom.operators.entities import by_rare_words

    r = random.Random(2)
    sets = [sorted({r.choice("abcdefghij") for _ in range(r.randint(1, 7))}) for _ in range(60)]
    left = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id int, a array<string>")
    right = left.selectExpr("id as other", "a as b")
    pairs = {(x.id, x.other) for x in by_rare_words(left, right, 0.6).collect()}
    near = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))}
    assert near <= pairs and len(pairs) < 60 * 60


def test_steps_and_breaker_probes(spark):
    from ledgerloom.operators.steps import run_steps
    from ledgerloom.streaming.progress import breaker_probes

    run = run_steps(spark.range(4), {"even": lambda d: d.where("id % 2 = 0"), "bad": lambda d: d.select("nothing"), "off": lambda d: d.limit(0)}, enabled=["even", "bad"])
    assert run.result.count() == 2 and [(n, e is None) for _, n, _, e in run.log] == [("even", True), ("bad", False)]
    events = spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}", 1, "error" if i < 3 else "view") for i in (0, 1, 2, 5, 40)], "event_id long, ts string, user_id long, event_type string")
    assert [x.state for x in breaker_probes(events, failures=3, pause=30).orderBy("event_id").collect()] == ["closed", "closed", "closed", "open", "closed"]


def test_runnable_steps_of_each_row(spark):
    from ledgerloom.operators.steps import runnable

    rows = [(1, ["ingestion"], "x"), (2, None, "y"), (3, [], "z"), (3, [], "z"), (4, ["ingestion", "ocr", "document_classifier", "embedding"], None)]
    df = spark.createDataFrame(rows, "run_id int, done array<string>, step_note string")
    got = sorted((r.run_id, r.step) for r in runnable(df, ["ingestion", "ocr", "document_classifier", "embedding"]).collect())
    assert got == [(1, "document_classifier"), (1, "ocr"), (2, "ingestion"), (3, "ingestion"), (3, "ingestion")]
    assert runnable(df.limit(0), ["ingestion"]).count() == 0


def test_failed_runs_are_counted_once_for_each_dependent_step(spark):
    from ledgerloom.operators.steps import held_up

    failed = spark.createDataFrame([(1, "validation"), (1, "validation"), (2, "validation"), (None, "export"), (3, None)], "run_id int, step string")
    got = {(r.step, r.downstream): r.failed_runs for r in held_up(spark, failed).collect()}
    assert got[("validation", "export")] == got[("validation", "confidence_scoring")] == 2
    assert got[("export", "evaluation")] == 0 and got[("ingestion", "ocr")] == 0


def test_run_steps_counts_rows_in_one_pass(spark):
    from ledgerloom.operators.steps import run_steps

    run = run_steps(spark.range(10), {"even": lambda d: d.where("id % 2 = 0"), "bad": lambda d: d.select("nothing"), "none": lambda d: d.where("id > 99")})
    assert run.rows() == {0: 5, 2: 0}
