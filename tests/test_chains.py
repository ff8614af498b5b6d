"""Chains over single rows and orders of arrival: spans of values, suppliers in order, against plain Python."""

import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import entities as N
from ledgerloom.operators import linking as A
from ledgerloom.operators import spans as SP

WORDS = ["Total", "is", "100.00", "euros", "Invoices", "from", "(ACME)", "Corp,", "tel", "12-34", "56", "no", "Total"]


@pytest.mark.parametrize(
    "value, evidence, link, ids",
    [
        ("100.00", "", "value", [2]),  # a piece of the text
        ("is 100.00 EUROS", "", "value", [1, 2, 3]),
        ("otal is 1", "", "value", [1]),  # only whole words
        ("acme", "", "value", [6]),  # marks around a word
        ("Total", "", "value", [0]),  # the first place
        ("invoice from mars", "", "value", [4, 5]),  # plural, longest run
        ("invoice of mars and moon", "", None, None),  # fewer than half
        ("x 100.00", "", "word", [2]),  # words without digits move the place on, so no digits are found behind them
        ("qq euros total", "", "word", [0, 3, 12]),  # any equal word
        ("absent", "corp, tel", "evidence", [7, 8]),
        ("100.00", "nowhere", "value", [2]),
        ("null", "Total", None, None),
        ("  ", "Total", None, None),
        (None, "Total", None, None),
        ("999", "", None, None),
    ],
)
def test_links_of_the_span_chain(spark, value, evidence, link, ids):
    df = spark.createDataFrame([(WORDS, value, evidence)], "ws array<string>, value string, evidence string")
    got = df.select(SP.field_span(F.col("ws"), F.col("value"), F.col("evidence")).alias("s")).first().s
    assert (got and (got.link, got.ids)) == (link and (link, ids))


def test_digits_of_a_value(spark):
    for words, value, ids in ((["12-34", "56", "Total"], "y 1234", [0]), (["12-34", "56", "7"], "y 3456 x", [1]), (["12", "34", "56"], "no. 12/34", [0, 1]), (["a", "b"], "no 5", None)):
        got = spark.createDataFrame([(words, value)], "ws array<string>, value string").select(SP.field_span(F.col("ws"), F.col("value"), F.lit("")).alias("s")).first().s
        assert (got and got.ids) == ids, value


def test_boxes_of_spans_and_pages_without_words(spark):
    words = spark.createDataFrame([(1, p, i, w, 10 * i, p, 10 * i + 8, p + 5) for p in (0, 1) for i, w in enumerate(WORDS[:4])], "doc_id long, page long, pos long, word string, x0 long, y0 long, x1 long, y1 long")
    fields = spark.createDataFrame([(1, "TOTAL", "is 100.00", None), (2, "TOTAL", "is", None)], "doc_id long, field string, value string, evidence string")
    got = sorted(map(tuple, SP.field_boxes(words, fields).collect()))
    assert got == [(1, p, "TOTAL", "is 100.00", "value", 2, 10, p, 28, p + 5) for p in (0, 1)]
    assert SP.field_boxes(words.limit(0), fields).count() == 0


def one_by_one(names):
    """The entities by a plain loop: id -> id that opened its entity."""
    said = lambda n: "Unknown" if not (n or "").strip() else n
    drop = {*N.LEGAL, *N.PREFIXES, *N.SMALL}
    key = lambda n: " ".join(sorted(w for w in re.sub(r"[^\w\s&.-]", "", said(n).strip().lower()).split() if w not in drop))
    known, members, out = {}, {}, {}
    for i, name in sorted(names):
        k = key(name)
        if k not in known:
            best = max(((max(N.indel_ratio(k, m) for m in ms), -e) for e, ms in members.items() if k and any(ms)), default=(0, 0))
            known[k] = -best[1] if best[0] >= N.ENTITY else i
            members.setdefault(known[k], []).append(k)
        out[i] = known[k]
    return out


def test_suppliers_join_in_order_of_arrival(spark):
    r = random.Random(8)
    names = [None, "", "Unknwn", "SARL", "ltd", "a b", "B A"]
    for _ in range(130):
        base = r.choice(["acme tools", "supplier 000001", "berg und co", "müller söhne", "delta"])
        text = list(base)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(text) + 1)
            text[k : k + r.randint(0, 1)] = r.choice("abc01 é")
        names.append(r.choice(["", "Ste ", "The "]) + "".join(text) + r.choice(["", " LTD", " sarl"]))
    rows = list(enumerate(names))
    df = spark.createDataFrame(rows, "id long, name string")
    linked = A.linked_suppliers(df).cache()
    want = one_by_one(rows)
    assert {x.id: x.entity for x in linked.collect()} == want and len(set(want.values())) > 5
    listed = {x.entity: x for x in A.entity_list(df, linked).collect()}
    assert set(listed) == set(want.values()) and sum(x.invoices for x in listed.values()) == len(rows)
    assert all(x.canonical == (names[e] or "Unknown") for e, x in listed.items())
    assert A.linked_suppliers(df.limit(0)).count() == 0


def test_entities_of_several_opening_names_are_handed_down(spark):
    links = [(3, 1), (3, 2), (4, 3), (5, 2), (6, 5), (6, 4), (8, 7)]
    got = A.first_opened(spark.createDataFrame([(i,) for i in range(1, 10)], "id long"), spark.createDataFrame(links, "id long, other long")).collect()
    assert {x.id: x.entity for x in got} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 2, 6: 1, 7: 7, 8: 7, 9: 9}


def test_candidates_lose_no_pair_and_score_few(spark):
    names = [f"supplier#{i:09d}" for i in range(120)] + ["", "ab", "ba", "abc"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    right = df.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor"))
    for least in (0.6, 0.8, 0.95):
        got = {(x.id, x.vendor_id) for x in N.candidates(df, right, least).collect()}
        assert {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if N.indel_ratio(N.sorted_words(a), N.sorted_words(b)) >= least} <= got
    assert len(got) < 0.1 * len(names) ** 2


@pytest.mark.parametrize("alphabet, low, high", [("abcde ", 0, 14), ("ab ", 50, 150), ("aé\U0001f600b", 55, 70)])
@pytest.mark.parametrize("best", [False, True])
def test_blocks_of_names_score_as_one_by_one(alphabet, low, high, best):
    r = random.Random(3)
    forms = [N.sorted_words("".join(r.choice(alphabet) for _ in range(r.randint(low, high)))) for _ in range(70)]
    forms += [f[:-1] + "z" for f in forms[:20]]
    block = pd.DataFrame({"key": range(len(forms)), "form": forms, "bits": [N.signature(f) for f in forms]})
    for earlier in (False, True):
        got = {(i, j): s for i, j, s in N.near_of_blocks(block, block.sample(frac=1, random_state=1), 0.7, best, earlier).itertuples(index=False)}
        want = {(i, j): s for i, a in enumerate(forms) for j, b in enumerate(forms) if (j < i or not earlier) and (s := N.indel_ratio(a, b)) >= 0.7}
        top = {i: max(s for (k, _), s in want.items() if k == i) for i, _ in want}
        assert {p: s for p, s in want.items() if s == top[p[0]] or not best}.items() <= got.items() <= want.items()


def test_names_alike_are_compared_many_at_once():
    forms = [f"sarl supplier#{i:09d}" for i in range(4000)]
    asked = pd.DataFrame({"key": range(4000), "form": forms, "bits": [N.signature(f) for f in forms]})
    known = asked.assign(form=[f[5:] for f in forms], bits=[N.signature(f[5:]) for f in forms])
    began = time.monotonic()
    got = N.near_of_blocks(asked, known, 0.8, True, False)
    assert (got["id"] == got["vendor_id"]).all() and len(got) == 4000
    assert time.monotonic() - began < 30  # sixteen million similarities, which take minutes one by one


def test_entities_at_the_end_of_long_chains(spark):
    links = [(i, i - 1) for i in range(2, 400)] + [(500, 399), (500, 450), (501, 500), (502, 501), (502, 460)]
    ids = [*range(1, 400), 450, 460, 500, 501, 502]
    got = A.first_opened(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "id long, other long")).collect()
    assert {x.id: x.entity for x in got} == {i: i if i in (450, 460) else 1 for i in ids}
