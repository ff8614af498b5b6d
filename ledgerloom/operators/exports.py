"""Invoices as UBL 2.1 XML and EDI 810, as string templates over one row with its array of items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    return F.format_string("%.2f", F.floor(F.coalesce(c, F.lit(0.0)) * 100 + 0.5) / 100)


def _xml(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _tag(name: str, body: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), body, F.lit(f"</{name}>"))


def ubl_invoice(currency: str = "EUR") -> Column:
    """XML of columns doc_id, supplier, invoice_date, total, items (description, quantity, unit_price, sub_total)."""
    cur = f' currencyID="{currency}"'
    lines = F.transform(F.coalesce("items", F.array().cast("array<struct<pos:bigint,description:string,quantity:double,unit_price:double,sub_total:double>>")), lambda x, i: _tag("cac:InvoiceLine", F.concat(
        _tag("cbc:ID", (i + 1).cast("string")), _tag("cac:Item", _tag("cbc:Name", _xml(x["description"]))), _tag("cbc:InvoicedQuantity", money(x["quantity"]), ' unitCode="C62"'),
        _tag("cbc:PriceAmount", money(x["unit_price"]), cur), _tag("cbc:LineExtensionAmount", money(x["sub_total"]), cur))))
    total = money(F.col("total"))
    space = "".join(f' xmlns{p}="urn:oasis:names:specification:ubl:schema:xsd:{n}-2"' for p, n in ((":cbc", "CommonBasicComponents"), (":cac", "CommonAggregateComponents"), ("", "Invoice")))
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), _tag("Invoice", F.concat(
        _tag("cbc:ID", F.col("doc_id").cast("string")), _tag("cbc:IssueDate", F.col("invoice_date").cast("string")), F.lit(f"<cbc:DocumentCurrencyCode>{currency}</cbc:DocumentCurrencyCode><cbc:InvoiceTypeCode>380</cbc:InvoiceTypeCode>"),
        F.coalesce(_tag("cac:AccountingSupplierParty", _tag("cac:Party", _tag("cac:PartyName", _tag("cbc:Name", _xml(F.col("supplier")))))), F.lit("")),
        _tag("cac:LegalMonetaryTotal", F.concat(_tag("cbc:TaxExclusiveAmount", total, cur), _tag("cbc:TaxInclusiveAmount", total, cur), _tag("cbc:PayableAmount", total, cur))),
        F.array_join(lines, "")), space))


def edi_810(stamp: str = "240101*0000") -> Column:
    """Segments of the same columns, one a line; the count in SE leaves out the two envelope segments before it."""
    day = F.date_format("invoice_date", "yyyyMMdd")
    lines = F.transform("items", lambda x: F.concat(F.lit("IT1**"), money(x["quantity"]), F.lit("*UN*"), money(x["unit_price"]), F.lit("**UP*"), F.left(x["description"], F.lit(40)), F.lit("~")))
    n = F.coalesce(F.nullif(F.size("items"), F.lit(-1)), F.lit(0))
    return F.concat_ws("\n", F.array(F.lit(f"ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *{stamp}*U*00401*000000001*0*P*>~"), F.lit(f"GS*IN*SENDER*RECEIVER*20{stamp}*1*X*004010~"), F.lit("ST*810*0001~"),
        F.concat(F.lit("BIG*"), day, F.lit("*"), F.col("doc_id").cast("string"), F.lit("**"), day, F.lit("~")), F.concat(F.lit("N1*SU*"), F.left(F.coalesce("supplier", F.lit("SUPPLIER")), F.lit(35)), F.lit("~")), F.lit("ITD*01*3**30~")),
        lines, F.array(F.concat(F.lit("TDS*"), money(F.col("total")), F.lit("~")), F.concat(F.lit("SE*"), (n + 5).cast("string"), F.lit("*0001~")), F.lit("GE*1*1~"), F.lit("IEA*1*000000001~")))
