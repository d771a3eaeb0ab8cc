"""Fields, items and checks of invoices in text form."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import invoices

CLEAN = """From: Supplier Ltd
12 High Road
Springfield

Invoice # A-17
Invoice Date: 2024-03-01
Due Date: March 31, 2024
EIN: DE123456789
Bill To: Buyer Inc
Widget 2 10.00 20.00
Gadget 3 10.00 30.00
Amount Due: 60.00 EUR
Subtotal: 50.00
Tax: 10.00
"""
SCHEMA = "doc_id string, text string"
TODAY = "2024-06-01"


def processed(spark, texts, **more):
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    return {r["doc_id"]: r for r in invoices.process(docs, ["doc_id"], F.lit(TODAY).cast("date"), **more).collect()}


def test_clean_invoice(spark):
    r = processed(spark, {"a": CLEAN})["a"]
    assert (r["invoice_number"], r["invoice_date"], r["due_date"], r["currency"]) == ("A-17", "2024-03-01", "2024-03-31", "EUR")
    assert tuple(r["vendor"]) == ("Supplier Ltd", "12 High Road, Springfield", "DE123456789") and r["buyer"]["name"] == "Buyer Inc"
    assert (r["subtotal"], r["tax"], r["total"], r["tax_rate_percent"]) == (50.0, 10.0, 60.0, 20.0)
    assert [tuple(i) for i in r["line_items"]] == [("Widget", 2.0, 10.0, 20.0), ("Gadget", 3.0, 10.0, 30.0)]
    assert {r[c] for c in invoices.CHECKS} == {"passed"} and (r["overall_status"], r["status"], r["errors"], r["warnings"]) == ("passed", "passed", [], [])


@pytest.mark.parametrize(
    ("change", "check", "expected"),
    [
        (("Amount Due: 60.00", "Amount Due: 60.02"), "totals_reconcile", "passed"), (("Amount Due: 60.00", "Amount Due: 60.03"), "totals_reconcile", "failed"),
        (("Widget 2 10.00 20.00", "Widget 2 10.00 20.05"), "line_items_reconcile", "passed"), (("Widget 2 10.00 20.00", "Widget 2 10.00 20.06"), "line_items_reconcile", "failed"),
        (("Tax: 10.00", "Tax: 15.00"), "tax_plausible", "passed"), (("Tax: 10.00", "Tax: 15.01"), "tax_plausible", "warning"), (("Tax: 10.00", "Tax: 0.00"), "tax_plausible", "passed"),
        (("2024-03-01", "2025-03-01"), "date_valid", "warning"), (("Invoice # A-17", "Number unknown"), "invoice_number_present", "failed"),
        (("Amount Due: 60.00 EUR\nSubtotal: 50.00\nTax: 10.00", "nothing"), "totals_reconcile", "skipped"),
    ],
)
def test_checks(spark, change, check, expected):
    assert processed(spark, {"a": CLEAN.replace(*change)})["a"][check] == expected


def test_missing_amounts_are_inferred(spark):
    gone = {"total": "Amount Due: 60.00 EUR\n", "tax": "Tax: 10.00\n"}
    found = processed(spark, {k: CLEAN.replace(v, "") for k, v in gone.items()})
    assert found["tax"]["tax"] == 10.0
    df = spark.createDataFrame([(None, 10.0, 60.0), (50.0, None, 60.0), (50.0, 10.0, None), (None, None, 1.0)], "s double, t double, a double")
    rows = [tuple(r[0]) for r in df.select(invoices.inferred_amounts(*map(F.col, "sta"))).collect()]
    assert rows == [(50.0, 10.0, 60.0)] * 3 + [(None, None, 1.0)]


def test_repeats(spark):
    found = processed(spark, {"a": CLEAN, "b": CLEAN, "c": CLEAN.replace("A-17", "A-18"), "d": "x", "e": "x"}, known=spark.createDataFrame([("A-18",)], "invoice_number string"))
    assert [found[k]["duplicate_check"] for k in "abcde"] == ["passed", "warning", "warning", "skipped", "skipped"]


def test_tables(spark):
    tables = [[["Foo", "Bar"], ["1", "2"]], [["Item", "Qty", "Unit Price", "Amount"], ["Bolt", "4", "2.50", None], ["Nut", "2", None, "3.00"], ["", None, " ", ""], ["Total", "", "", "13.00"]]]
    docs = spark.createDataFrame([("a", CLEAN, tables), ("b", CLEAN, [tables[0]]), ("c", CLEAN, None)], SCHEMA + ", tables array<array<array<string>>>")
    found = {r["doc_id"]: [tuple(i) for i in r["line_items"]] for r in invoices.line_items(docs).collect()}
    assert found["a"] == [("Bolt", 4.0, 2.5, 10.0), ("Nut", 2.0, 1.5, 3.0)]
    assert found["b"] == found["c"] == [("Widget", 2.0, 10.0, 20.0), ("Gadget", 3.0, 10.0, 30.0)]


def test_vendor_without_a_label(spark):
    r = processed(spark, {"a": "12\nACME Works\nInvoice # 5\n"})["a"]
    assert r["vendor"]["name"] == "ACME Works" and r["currency"] == "USD"
    assert processed(spark, {"a": ""})["a"]["status"] == "failed"


def test_summary(spark):
    docs = invoices.process(spark.createDataFrame([("a", CLEAN)], SCHEMA), ["doc_id"], F.lit(TODAY).cast("date"))
    rows = {r["field"]: r["value"] for r in invoices.summary(docs, "doc_id").collect()}
    assert len(rows) == 13 and rows["vendor.name"] == "Supplier Ltd"


def test_items_are_worked_out_once(spark):
    """Headers are read once for each table and items once for each document; documents without items have no rows."""
    tables = [[["Item", " QTY ", "Unit price", "Amount"], ["a", "2", "1.5", None], [None, " ", None, ""], ["VAT 5%", "1", "1", "1"], ["b", "4", None, "1,000.00"]]]
    docs = spark.createDataFrame([(1, "", tables), (2, "", []), (3, "Widget 2 10.00 20.00", None), (4, "nothing", [[["Item"]]])], "doc_id long, text string, tables array<array<array<string>>>")
    found = invoices.item_rows(invoices.line_items(docs), "doc_id")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", 2.0, 1.5, 3.0), (1, "b", 4.0, 250.0, 1000.0), (3, "Widget", 2.0, 10.0, 20.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("particulars") == 1
