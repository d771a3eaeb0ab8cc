"""Queries on invoices; their texts are rendered from the orders and their line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import invoices
from tessera.plans.catalog import Given, query, table


def money(cents: str) -> str:
    return f"CONCAT(CAST(CAST(FLOOR(({cents}) / 100) AS BIGINT) AS STRING), '.', LPAD(CAST(({cents}) % 100 AS STRING), 2, '0'))"


#: Orders with amounts in cents: some totals are a little off, some taxes are odd, some numbers come twice.
ORDERS = """
SELECT o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS net, CASE WHEN o_orderkey % 9 = 0 THEN 0 WHEN o_orderkey % 9 = 1 THEN CAST(FLOOR(ROUND(o_totalprice * 100) * 0.4) AS BIGINT)
    ELSE CAST(FLOOR(ROUND(o_totalprice * 100) * 0.2) AS BIGINT) END AS tax,
  CASE o_orderkey % 11 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN -50 ELSE 0 END AS off, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS number FROM {orders}"""
TEXT = Given(f"""
WITH o AS ({ORDERS})
SELECT o_orderkey AS doc_id, net, tax, net + tax + off AS total, number, CONCAT('From: Supplier ', CAST(o_orderkey % 17 AS STRING), ' Ltd', CHR(10), '12 High Road', CHR(10), 'Springfield', CHR(10), CHR(10),
  'Invoice No. ', CAST(number AS STRING), CHR(10), 'Date: 1996-03-', LPAD(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), CHR(10), 'Due Date: March ', CAST(1 + o_orderkey % 28 AS STRING), ', 1997', CHR(10),
  'EIN: DE', CAST(100000000 + o_orderkey AS STRING), CHR(10), 'Bill To: Buyer ', CAST(o_orderkey % 5 AS STRING), CHR(10), CHR(10),
  'Widget large 2 10.00 20.00', CHR(10), 'Gadget 3 ', {money('net % 10000')}, ' 1,234.50', CHR(10), 'Discount 1 5.00 5.00', CHR(10),
  'Amount Due: ', {money('net + tax + off')}, ' EUR', CHR(10), 'Subtotal: ', {money('net')}, CHR(10), 'Tax: ', {money('tax')}, CHR(10)) AS text FROM o""")
SUMS = Given("""
SELECT o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) / 100.0 AS subtotal, n_items, CASE o_orderkey % 4 WHEN 0 THEN CAST(ROUND(o_totalprice * 100) AS BIGINT) / 100.0 WHEN 1 THEN (CAST(ROUND(o_totalprice * 100) AS BIGINT) + 4) / 100.0
  WHEN 2 THEN (CAST(ROUND(o_totalprice * 100) AS BIGINT) + 7) / 100.0 ELSE items END AS items
FROM {orders} LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n_items, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0 AS items FROM {lineitem} GROUP BY l_orderkey) AS l ON l_orderkey = o_orderkey""")
CENTS = "CAST(round({} * 100) AS BIGINT)"


def cents(c):
    return F.round(F.col(c) * 100).cast("long")


@query(f"""
SELECT doc_id, CAST(number AS VARCHAR) AS invoice_number, '1996-03-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') AS invoice_date, '1997-03-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') AS due_date,
  'Supplier ' || doc_id % 17 || ' Ltd' AS vendor, '12 High Road, Springfield' AS address, 'DE' || (100000000 + doc_id) AS tax_id, 'Buyer ' || doc_id % 5 AS buyer, 'EUR' AS currency
FROM ({TEXT.sql})""")
def inv_extract_fields(spark, sf_dir):
    found = invoices.fields(TEXT(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "invoice_number", "invoice_date", "due_date", F.col("vendor.name").alias("vendor"), F.col("vendor.address").alias("address"), F.col("vendor.tax_id").alias("tax_id"), F.col("buyer.name").alias("buyer"), "currency")


@query(f"SELECT doc_id, net AS subtotal, tax, total FROM ({TEXT.sql})")
def inv_extract_amounts(spark, sf_dir):
    found = invoices.fields(TEXT(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", cents("subtotal").alias("subtotal"), cents("tax").alias("tax"), cents("total").alias("total"))


@query(f"""
SELECT doc_id, 'Widget large' AS description, CAST(2 AS BIGINT) AS quantity, CAST(1000 AS BIGINT) AS unit_price, CAST(2000 AS BIGINT) AS total FROM ({TEXT.sql})
UNION ALL SELECT doc_id, 'Gadget', 3, net % 10000, 123450 FROM ({TEXT.sql})""")
def inv_line_items_text(spark, sf_dir):
    found = invoices.item_rows(invoices.line_items(TEXT(spark, sf_dir).select("doc_id", "text")), "doc_id")
    return found.select("doc_id", "description", F.col("quantity").cast("long").alias("quantity"), cents("unit_price").alias("unit_price"), cents("total").alias("total"))


@query("""
SELECT l_orderkey, l_linenumber, 'part ' || l_partkey AS description, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_quantity * 100 END) AS BIGINT) AS total
FROM lineitem""")
def inv_line_items_table(spark, sf_dir):
    """Each line item as a table of its own; its unit price is missing, and for even lines its total."""
    item = table(spark, sf_dir, "lineitem")
    row = F.array(F.concat(F.lit("part "), "l_partkey"), F.col("l_quantity").cast("string"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity").cast("string")))
    tables = F.array(F.array(F.array(F.lit("Item"), F.lit(" QTY "), F.lit("Amount")), row, F.array(F.lit("Grand total"), F.lit("1"), F.lit("2"))))
    found = invoices.item_rows(invoices.line_items(item.select("l_orderkey", "l_linenumber", F.lit("").alias("text"), tables.alias("tables"))), "l_orderkey", "l_linenumber")
    return found.select("l_orderkey", "l_linenumber", "description", F.col("quantity").cast("long").alias("quantity"), cents("total").alias("total"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE 250 END::BIGINT AS unit_price, CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE CAST(l_quantity * 250 AS BIGINT) END AS total FROM lineitem""")
def inv_line_item_infer(spark, sf_dir):
    """Line 0 of three lacks its total, line 2 its price, line 1 both."""
    item = table(spark, sf_dir, "lineitem")
    third = F.col("l_linenumber") % 3
    given = F.struct(F.lit("x").alias("description"), F.col("l_quantity").alias("quantity"), F.when(third == 0, F.lit(2.5)).alias("unit_price"), F.when(third == 2, F.col("l_quantity") * 2.5).alias("total"))
    found = item.select("l_orderkey", "l_linenumber", given.alias("item")).withColumn("item", invoices.inferred_item(F.col("item"))).select("l_orderkey", "l_linenumber", "item.*")
    return found.select("l_orderkey", "l_linenumber", F.col("quantity").cast("long").alias("quantity"), cents("unit_price").alias("unit_price"), cents("total").alias("total"))


@query(f"""
WITH o AS ({ORDERS.replace('{orders}', 'orders')})
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE net END AS subtotal, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE tax END AS tax, net + tax AS total FROM o""")
def inv_amount_infer(spark, sf_dir):
    """Of each five orders one lacks its subtotal, one its tax, one its total, one nothing, one two amounts."""
    o = Given(ORDERS)(spark, sf_dir)
    part = F.col("o_orderkey") % 5
    hidden = lambda c, *parts: F.when(~part.isin(*parts), c / 100)
    found = o.select("o_orderkey", invoices.inferred_amounts(hidden(F.col("net"), 0, 4), hidden(F.col("tax"), 1, 4), hidden(F.col("net") + F.col("tax"), 2)).alias("a")).select("o_orderkey", "a.*")
    return found.select("o_orderkey", cents("subtotal").alias("subtotal"), cents("tax").alias("tax"), cents("total").alias("total"))


@query(f"SELECT doc_id, CASE WHEN abs(net + tax - total) <= 2 THEN 'passed' ELSE 'failed' END AS status FROM ({TEXT.sql})")
def inv_reconcile_totals(spark, sf_dir):
    found = invoices.fields(TEXT(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", invoices.totals_reconcile(F.col("subtotal"), F.col("tax"), F.col("total")).alias("status"))


@query(f"""
SELECT o_orderkey, CASE WHEN n_items IS NULL THEN 'skipped' WHEN abs({CENTS.format('items')} - {CENTS.format('subtotal')}) <= 5 THEN 'passed' ELSE 'failed' END AS status FROM ({SUMS.sql})""")
def inv_reconcile_items(spark, sf_dir):
    found = SUMS(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("items", "subtotal")})
    return found.select("o_orderkey", invoices.items_reconcile(F.col("n_items"), F.col("items"), F.col("subtotal")).alias("status"))


@query(f"SELECT doc_id, CASE WHEN net = 0 THEN 'skipped' WHEN tax * 100 <= 30 * net THEN 'passed' ELSE 'warning' END AS status FROM ({TEXT.sql})")
def inv_tax_plausible(spark, sf_dir):
    found = invoices.fields(TEXT(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", invoices.tax_plausible(F.col("subtotal"), F.col("tax")).alias("status"))


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY number ORDER BY doc_id) > 1 THEN 'warning' ELSE 'passed' END AS duplicate_check FROM ({TEXT.sql})")
def inv_duplicates(spark, sf_dir):
    found = TEXT(spark, sf_dir).select("doc_id", F.col("number").cast("string").alias("invoice_number"))
    return invoices.repeats(found, ["doc_id"]).select("doc_id", "duplicate_check")


@query(f"SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'warning' ELSE 'passed' END AS duplicate_check FROM ({TEXT.sql})")
def inv_known_duplicates(spark, sf_dir):
    """Against a table of numbers that earlier batches had."""
    found = TEXT(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("invoice_number"))
    return invoices.repeats(found, ["doc_id"], found.filter("doc_id % 13 = 0").select("invoice_number")).select("doc_id", "duplicate_check")


@query(f"""
WITH c AS (SELECT doc_id, total, abs(net + tax - total) > 2 AS off, abs(2000 + 123450 - net) > 5 AS items_off, net > 0 AND tax * 100 > 30 * net AS odd_tax, row_number() OVER (PARTITION BY number ORDER BY doc_id) > 1 AS again FROM ({TEXT.sql}))
SELECT doc_id, CASE WHEN off OR items_off OR total = 0 THEN 'failed' WHEN odd_tax OR again THEN 'passed_with_warnings' ELSE 'passed' END AS overall_status,
  CASE WHEN total = 0 THEN 'failed' ELSE 'passed' END AS field_completeness, CASE WHEN off OR total = 0 THEN 'failed' WHEN items_off OR odd_tax OR again THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM c""")
def inv_overall_status(spark, sf_dir):
    found = invoices.process(TEXT(spark, sf_dir).select("doc_id", "text"), ["doc_id"], F.lit("2024-01-01").cast("date"))
    return found.select("doc_id", "overall_status", "field_completeness", "status")


@query(f"SELECT CAST(count(*) * 13 AS BIGINT) AS n_rows, count(*) AS n_numbers FROM ({TEXT.sql})")
def inv_summary(spark, sf_dir):
    found = invoices.summary(invoices.fields(TEXT(spark, sf_dir).select("doc_id", "text")), "doc_id")
    return found.agg(F.count("*").alias("n_rows"), F.count_if(F.col("field") == "invoice_number").alias("n_numbers"))


#: Invoices in other words: each of the forms of a number, currencies by code and sign, a vendor in the first line, one amount missing.
FORMS = Given(f"""
WITH o AS ({ORDERS})
SELECT o_orderkey AS doc_id, net, tax, CONCAT(CASE WHEN o_orderkey % 2 = 0 THEN '1 Street' ELSE 'ab' END, CHR(10), 'Firm ', CAST(o_orderkey % 7 AS STRING), CHR(10),
  CASE o_orderkey % 5 WHEN 0 THEN 'Invoice #A-' WHEN 1 THEN 'Bill No. A-' WHEN 2 THEN 'Receipt # A-' WHEN 3 THEN 'INV-2024-0' ELSE 'Invoice Number: A-' END, CAST(o_orderkey AS STRING), CHR(10),
  'Issued On 0', CAST(1 + o_orderkey % 9 AS STRING), '/1', CAST(o_orderkey % 10 AS STRING), '/', CAST(2020 + o_orderkey % 8 AS STRING), CHR(10), 'ABN: X', CAST(o_orderkey AS STRING), CHR(10),
  'Grand Total: ', CASE o_orderkey % 4 WHEN 0 THEN '£' WHEN 1 THEN '€' WHEN 2 THEN '¥' ELSE '' END, {money('net + tax')}, CHR(10),
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CONCAT('Sub-Total: ', CASE o_orderkey % 4 WHEN 0 THEN '£' WHEN 1 THEN '€' WHEN 2 THEN '¥' ELSE '' END, {money('net')}, CHR(10)) END,
  CASE WHEN o_orderkey % 6 = 1 THEN '' ELSE CONCAT('VAT (20%): ', CASE o_orderkey % 4 WHEN 0 THEN '£' WHEN 1 THEN '€' WHEN 2 THEN '¥' ELSE '' END, {money('tax')}, CHR(10)) END) AS text FROM o""")
DAY = "(2020 + doc_id % 8) || '-0' || (1 + doc_id % 9) || '-1' || doc_id % 10"


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN '2024-0' || doc_id ELSE 'A-' || doc_id END AS invoice_number, {DAY} AS invoice_date, 'Firm ' || doc_id % 7 AS vendor, 'X' || doc_id AS tax_id,
  CASE doc_id % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 2 THEN 'JPY' ELSE 'USD' END AS currency FROM ({FORMS.sql})""")
def inv_other_forms(spark, sf_dir):
    found = invoices.fields(FORMS(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "invoice_number", "invoice_date", F.col("vendor.name").alias("vendor"), F.col("vendor.tax_id").alias("tax_id"), "currency")


@query(f"SELECT doc_id, net AS subtotal, tax, net + tax AS total, CASE WHEN net > 0 THEN CAST(floor(tax * 100.0 / net + 0.005) AS BIGINT) END AS rate FROM ({FORMS.sql})")
def inv_inferred_amounts(spark, sf_dir):
    """A missing subtotal or tax comes from the others; the tax rate in whole percents."""
    found = invoices.fields(FORMS(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *[cents(c).alias(c) for c in ("subtotal", "tax", "total")], F.floor(F.col("tax_rate_percent") + 0.001).cast("long").alias("rate"))


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'failed' WHEN {DAY} > '2024-06-30' THEN 'warning' ELSE 'passed' END AS date_valid,
  CASE WHEN doc_id % 10 = 9 THEN 'Invoice date could not be extracted' END AS error, CASE WHEN doc_id % 10 <> 9 AND {DAY} > '2024-06-30' THEN 'Invoice date is in the future' END AS warning
FROM ({FORMS.sql})""")
def inv_dates_checked(spark, sf_dir):
    """Dates before and after the day of the check, and none in every tenth invoice."""
    text = F.when(F.col("doc_id") % 10 == 9, F.regexp_replace("text", "Issued On [0-9/]+", "")).otherwise(F.col("text"))
    found = invoices.process(FORMS(spark, sf_dir).select("doc_id", text.alias("text")), ["doc_id"], F.lit("2024-06-30").cast("date"))
    said = lambda column, words: F.get(F.filter(column, lambda x: F.contains(x, F.lit(words))), F.lit(0))
    return found.select("doc_id", "date_valid", said("errors", "date").alias("error"), said("warnings", "date").alias("warning"))


@query(f"SELECT doc_id, unnest(['currency', 'due_date', 'invoice_number', 'tax']) AS field, unnest(['EUR', '1997-03-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0'), CAST(number AS VARCHAR), CAST(tax AS VARCHAR)]) AS value FROM ({TEXT.sql})")
def inv_summary_values(spark, sf_dir):
    """Fields as rows; the tax in cents."""
    found = invoices.summary(invoices.fields(TEXT(spark, sf_dir).select("doc_id", "text")), "doc_id").filter(F.col("field").isin("currency", "due_date", "invoice_number", "tax"))
    return found.select("doc_id", "field", F.when(F.col("field") == "tax", F.round(F.col("value").cast("double") * 100).cast("long").cast("string")).otherwise(F.col("value")).alias("value"))
