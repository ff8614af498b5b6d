"""Weights learned from batches of evaluations, against a plain loop over the batches."""

import random

from ledgerloom.operators import calibration as C

KINDS = list(C.START)


def loop(records, start=C.START):
    """The plain way: one batch after the other, in hundredths."""
    out = {}
    for key in {k for k, b, _ in records if b is not None}:
        w = {k: round(v * 100) for k, v in start.items()}
        for batch in sorted({b for k, b, _ in records if k == key and b is not None}):
            got = [a for k, b, a in records if (k, b) == (key, batch) and a is not None]
            mean = sum(got) / len(got) if got else None
            if len(got) >= 3:
                if mean < 0.5:
                    w["ocr_conf"], w["evidence_match"] = min(60, w["ocr_conf"] + 5), max(20, w["evidence_match"] - 5)
                elif mean > 0.85:
                    w["format_valid"], w["ocr_conf"] = min(40, w["format_valid"] + 5), max(20, w["ocr_conf"] - 5)
                if mean < 0.4:
                    w["vlm_error_deduction"] = min(50, w["vlm_error_deduction"] + 5)
                elif mean > 0.8:
                    w["vlm_error_deduction"] = max(10, w["vlm_error_deduction"] - 5)
            out[key, batch] = (len(got), *[v / 100 for v in w.values()])
    return out


def fold(spark, records, **more):
    df = spark.createDataFrame(records, "key string, batch long, accuracy double")
    return {(r.key, r.batch): (r.n, *[r[k] for k in KINDS]) for r in C.calibrated(df, **more).collect()}


def test_fold_equals_a_loop_for_any_width_of_blocks(spark):
    rnd = random.Random(3)
    records = [(k, b, rnd.choice([0.0, 0.25, 0.75, 1.0]) * rnd.choice([0.5, 1, 1])) for k in ("a", None) for b in range(-7, 33) for _ in range(rnd.randint(1, 6))]
    records += [("b", 5, 1.0)] * 4 + [("a", 40, None), ("a", None, 1.0), ("a", 1000, 0.0)]
    want = loop(records)
    for width in (2, 8, 128):
        assert fold(spark, records, width=width) == want


def test_order_of_batches_matters(spark):
    low, high = [0.0] * 3, [1.0] * 3
    batches = [high] * 5 + [low]
    there = fold(spark, [("a", i, x) for i, b in enumerate(batches) for x in b])
    back = fold(spark, [("a", i, x) for i, b in enumerate(reversed(batches)) for x in b])
    assert there["a", 5] == (3, 0.25, 0.35, 0.4, 0.15, 0.15, 0.2)
    assert back["a", 5] == (3, 0.2, 0.35, 0.4, 0.1, 0.15, 0.2)


def test_goes_on_from_weights_of_an_earlier_run(spark):
    records = [("a", b, float(b % 2)) for b in range(6) for _ in range(3)]
    first = spark.createDataFrame([r for r in records if r[1] < 3], "key string, batch long, accuracy double")
    w = C.latest(C.calibrated(first)).first()
    rest = fold(spark, [r for r in records if r[1] >= 3], start={k: w[k] for k in KINDS})
    assert rest["a", 5] == fold(spark, records)["a", 5]


def test_few_records_and_no_records(spark):
    assert fold(spark, [("a", 1, 0.0), ("a", 1, 0.0)]) == {("a", 1): (2, *C.START.values())}
    assert fold(spark, []) == {}
