"""The rule engine: each rule is one Column of an issue struct or null; a document's issues are one array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tolerance of sums, allowed tax rates, cutoffs of confidence, history sizes.
TOLERANCE, VAT_RATES, REVIEW_BELOW, HIGH_FROM = 0.02, (0.0, 5.5, 10.0, 20.0), 0.70, 0.85
LOOKBACK, LEAST_HISTORY, DUPLICATE_DAYS, SIGMAS = 50, 5, 30, 3


def issue(when: Column, rule: str, severity: str, fields: list[str]) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.array(*[F.lit(f) for f in fields]).alias("fields")))


def implied_vat(net: Column, gross: Column) -> Column:
    return F.when(net > 0, F.round((gross - net) / net * 100, 1))


def invoice_issues(inv: DataFrame) -> DataFrame:
    """`issues` for rows with total, net, gross, n_lines: required fields, sums, tax, ranges."""
    net, gross, total = F.col("net"), F.col("gross"), F.col("total")
    return inv.withColumn("issues", F.array_compact(F.array(
        issue(F.col("n_lines") == 0, "required_fields", "error", ["LINE/DESCRIPTION"]),
        issue((net > 0) & (F.abs(total - net) / net > TOLERANCE), "arithmetic", "warning", ["TOTAL", "line_items"]),
        issue((net > 0) & (F.abs(implied_vat(net, gross) - F.col("expected_vat")) > 1.0), "vat_context", "warning", ["TOTAL", "TOTAL_AMOUNT"]),
        issue(implied_vat(net, gross) < -1.0, "arithmetic", "error", ["TOTAL", "TOTAL_AMOUNT"]),
        issue(total < 0, "ranges", "error", ["TOTAL"]),
        issue(total > 10_000_000, "unusual_total", "warning", ["TOTAL"]),
    )))


def issue_counts(df: DataFrame) -> DataFrame:
    count = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    return df.withColumns({"errors": count("error"), "warnings": count("warning")}).withColumn("is_valid", F.col("errors") == 0)


def line_checks(items: DataFrame) -> DataFrame:
    """Lines whose rounded quantity * price misses the subtotal by more than the tolerance; only positive numbers count."""
    expected = F.round(F.col("quantity") * F.col("unit_price") + 1e-7, 2)
    good = (F.col("quantity") > 0) & (F.col("unit_price") > 0) & (F.col("sub_total") > 0)
    return items.where(good & (F.abs(expected - F.col("sub_total")) / F.col("sub_total") > TOLERANCE)).withColumn("expected", expected)


def amount_anomalies(inv: DataFrame) -> DataFrame:
    """Totals beyond mean + 3 standard deviations of the vendor's last 50 earlier invoices, if there are 5."""
    before = W.partitionBy("vendor_id").orderBy("invoice_date", "doc_id").rowsBetween(-LOOKBACK, -1)
    seen = inv.withColumns({"n": F.count("total").over(before), "mean": F.avg("total").over(before), "sd": F.stddev_samp("total").over(before)})
    return seen.where((F.col("n") >= LEAST_HISTORY) & (F.col("sd") > 0) & (F.col("total") > F.col("mean") + SIGMAS * F.col("sd")))


def duplicates(inv: DataFrame) -> DataFrame:
    """Invoices with an earlier-arrived one of the vendor, dated from 30 days before on, of the same total to the cent.

    Same total is an equi-join on cents and their neighbours, so no vendor's history is paired with itself.
    """
    cents = F.floor(F.col("total") * 100 + 0.5).cast("long")
    rows = inv.where("total <> 0").select("doc_id", "vendor_id", "invoice_date", "total", "arrival", cents.alias("cents"))
    old = rows.select("vendor_id", "cents", F.col("doc_id").alias("old_id"), F.col("invoice_date").alias("old_date"), F.col("total").alias("old_total"), F.col("arrival").alias("old_arrival"))
    new = rows.withColumn("cents", F.explode(F.array(F.col("cents") - 1, F.col("cents"), F.col("cents") + 1)))
    met = new.join(old, ["vendor_id", "cents"]).where((F.col("old_arrival") < F.col("arrival")) & (F.col("old_date") >= F.date_sub("invoice_date", DUPLICATE_DAYS)) & (F.abs(F.col("total") - F.col("old_total")) < 0.01))
    return met.groupBy("doc_id").agg(F.min("old_id").alias("duplicate_of"))


def direct_confidence(errors: Column, warnings: Column, bad_format: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - 0.3 * errors - 0.15 * warnings - F.when(bad_format, 0.2).otherwise(0.0))


def validator_adjustment(errors: Column, warnings: Column) -> Column:
    return -0.3 * errors - 0.1 * warnings


def consistency(total: Column, untaxed: Column, tax: Column, lines: Column) -> Column:
    """Scores of three fields by the others: total (1 if it isn't below the untaxed amount, else 0.3), tax (1 within a cent of
    the difference, 0.7 within one, else 0.3), untaxed (1 within a cent of the sum of lines, 0.7 within a tenth, else 0.3);
    0.5 where something is missing."""
    grade = lambda gap, near: F.when(gap < 0.01, 1.0).when(near, 0.7).otherwise(0.3)
    gap_tax, gap_lines = F.abs(tax - (total - untaxed)), F.abs(lines - untaxed)
    scores = {"TOTAL_AMOUNT": F.when(total >= untaxed, 1.0).otherwise(0.3), "TAX_AMOUNT": grade(gap_tax, gap_tax < 1), "TOTAL_UNTAXED": grade(gap_lines, gap_lines / F.greatest(lines, F.lit(1.0)) < 0.1)}
    whole = {"TOTAL_AMOUNT": total + untaxed, "TAX_AMOUNT": total + untaxed + tax, "TOTAL_UNTAXED": lines + untaxed}
    return F.struct(*[F.when(whole[k].isNull(), 0.5).otherwise(v).alias(k) for k, v in scores.items()])
