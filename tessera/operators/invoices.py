"""Fields, line items and checks of invoices in text form.

Everything is column expressions over (doc_id, text, tables); a document is one row and never leaves its task. Duplicates
within a batch come from one window over the invoice number, those of earlier batches from a semi join with a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.columns import amount, bind, date, extract, first_match

TOTAL_TOLERANCE, ITEMS_TOLERANCE = 0.02, 0.05
LOOK_AHEAD = 60
ITEMS = "array<struct<description:string,quantity:double,unit_price:double,total:double>>"


def invoice_number(text: Column) -> Column:
    return first_match(text, fixed.INVOICE_NUMBERS)


def first_date(text: Column) -> Column:
    """The first date by the order of the formats, as yyyy-MM-dd."""
    return F.date_format(date(F.coalesce(*[extract(text, p) for p in fixed.DATES])), "yyyy-MM-dd")


def any_date(text: Column) -> Column:
    """The first date of a format that can be read, as yyyy-MM-dd."""
    return F.date_format(F.coalesce(*[date(extract(text, p)) for p in fixed.DATES]), "yyyy-MM-dd")


def labelled_date(text: Column, label: str) -> Column:
    """A date in the characters behind the first label."""
    return bind(extract(text, rf"(?is){label}(.{{0,{LOOK_AHEAD}}})"), first_date)


def currency(text: Column) -> Column:
    signs = [F.when(F.contains(text, F.lit(sign)), F.lit(code)) for sign, code in fixed.CURRENCY_SIGNS]
    return F.coalesce(F.upper(extract(text, fixed.CURRENCY_CODES)), *signs, F.lit("USD"))


def amounts(text: Column) -> Column:
    """struct(subtotal, tax, total), the missing one of three inferred from the others."""
    return inferred_amounts(*[amount(F.trim(extract(text, p))) for p in (fixed.SUBTOTAL, fixed.TAX, fixed.TOTAL)])


def inferred_amounts(subtotal: Column, tax: Column, total: Column) -> Column:
    known = F.struct(subtotal.alias("subtotal"), tax.alias("tax"), total.alias("total"))
    return bind(known, lambda x: F.struct(
        F.coalesce(x["subtotal"], F.round(x["total"] - x["tax"], 2)).alias("subtotal"),
        F.coalesce(x["tax"], F.round(x["total"] - x["subtotal"], 2)).alias("tax"),
        F.coalesce(x["total"], F.round(x["subtotal"] + x["tax"], 2)).alias("total"),
    ))


def section(text: Column, label: str) -> Column:
    """struct(name, address) behind the first line with a label: the rest of the line, then up to five lines."""
    labelled = lambda lines: F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(label), i)), lambda i: i.isNotNull()))

    def read(x: Column) -> Column:
        following = F.transform(F.slice(x["lines"], x["at"] + 2, 5), lambda y: F.trim(y))
        return F.struct(F.trim(F.regexp_replace(F.get(x["lines"], x["at"]), rf"^(?s).*?{label}", "")).alias("rest"), following.alias("following"))

    def own_lines(x: Column) -> Column:
        stops = F.transform(x["following"], lambda y, i: F.when((y == "") | y.rlike(fixed.SECTION_END), i))
        stop = F.coalesce(F.array_min(F.filter(stops, lambda i: i.isNotNull())), F.size(x["following"]))
        return F.concat(F.filter(F.array(x["rest"]), lambda y: y != ""), F.slice(x["following"], 1, stop))

    def named(own: Column) -> Column:
        return F.struct(F.get(own, F.lit(0)).alias("name"), F.when(F.size(own) > 1, F.array_join(F.slice(own, 2, F.size(own)), ", ")).alias("address"))

    at = bind(F.split(text, "\n", -1), lambda lines: F.struct(lines.alias("lines"), labelled(lines).alias("at")))
    return bind(at, lambda x: bind(read(x), lambda y: bind(own_lines(y), named)))


def vendor_name(text: Column, named: Column) -> Column:
    """The vendor's name, else the first line of more than three characters that doesn't begin with a digit."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    return F.coalesce(named, F.get(F.filter(lines, lambda x: (F.length(x) > 3) & ~x.rlike(r"^\d")), F.lit(0)))


def fields(docs: DataFrame) -> DataFrame:
    """``docs`` (text and other columns) with the fields of an invoice."""
    text = F.col("text")
    found = docs.withColumns({"__vendor": section(text, fixed.VENDOR_LABEL), "buyer": section(text, fixed.BUYER_LABEL), "__amounts": amounts(text)})
    found = found.withColumns({
        "invoice_number": invoice_number(text),
        "invoice_date": F.coalesce(labelled_date(text, fixed.INVOICE_DATE_LABEL), any_date(text)),
        "due_date": labelled_date(text, fixed.DUE_DATE_LABEL),
        "vendor": F.struct(vendor_name(text, F.col("__vendor.name")).alias("name"), F.col("__vendor.address").alias("address"), first_match(text, fixed.TAX_IDS).alias("tax_id")),
        "currency": currency(text),
        "subtotal": F.col("__amounts.subtotal"), "tax": F.col("__amounts.tax"), "total": F.col("__amounts.total"),
    })
    rate = F.when(F.col("subtotal") > 0, F.round(F.col("tax") / F.col("subtotal") * 100, 2))
    return found.withColumn("tax_rate_percent", rate).drop("__vendor", "__amounts")


# Line items.


def is_summary(description: Column) -> Column:
    return F.lower(F.coalesce(description, F.lit(""))).rlike("|".join(fixed.SUMMARY_WORDS))


def text_items(text: Column) -> Column:
    """Items of lines like ``description quantity price total``."""
    groups = [F.regexp_extract_all(text, F.lit(fixed.LINE_ITEM), F.lit(i)) for i in range(1, 5)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abcd", strict=True)])
    item = lambda x: F.struct(F.trim(x["a"]).alias("description"), amount(x["b"]).alias("quantity"), amount(x["c"]).alias("unit_price"), amount(x["d"]).alias("total"))
    return F.filter(F.transform(zipped, item), lambda x: ~is_summary(x["description"]))


def header_place(header: Column, words: list[str]) -> Column:
    """Place of the first header that contains one of the words, or null."""
    known = F.array(*[F.lit(w) for w in words])
    places = F.transform(header, lambda h, i: F.when(F.exists(known, lambda w: F.contains(F.lower(F.trim(F.coalesce(h, F.lit("")))), w)), i))
    return F.array_min(F.filter(places, lambda i: i.isNotNull()))


def inferred_item(item: Column) -> Column:
    """An item whose missing total or unit price comes from the others."""
    q, p, t = item["quantity"], item["unit_price"], item["total"]
    return F.struct(
        item["description"].alias("description"), q.alias("quantity"),
        F.when(p.isNull() & t.isNotNull() & (q != 0), F.round(t / q, 2)).otherwise(p).alias("unit_price"),
        F.when(t.isNull(), F.round(q * p, 2)).otherwise(t).alias("total"),
    )


def table_items(table: Column) -> Column:
    """Items of a table (rows of cells) with a header that names them; empty for other tables."""
    places = F.struct(*[header_place(F.get(table, F.lit(0)), words).alias(role) for role, words in fixed.ITEM_HEADERS.items()])
    # The header is read once for each table, not for each cell.
    return bind(places, lambda at: items_by_places(table, at))


def items_by_places(table: Column, places: Column) -> Column:
    cell = lambda row, role: F.when(places[role].isNotNull(), F.trim(F.get(row, places[role])))
    rows = F.filter(F.slice(table, 2, F.greatest(F.size(table), F.lit(1))), lambda row: F.exists(row, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    item = lambda row: F.struct(cell(row, "description").alias("description"), amount(cell(row, "quantity")).alias("quantity"), amount(cell(row, "unit_price")).alias("unit_price"), amount(cell(row, "total")).alias("total"))
    kept = F.filter(F.transform(rows, item), lambda x: ~is_summary(x["description"]))
    full = F.filter(F.transform(kept, inferred_item), lambda x: (F.coalesce(x["description"], F.lit("")) != "") | x["total"].isNotNull())
    usable = places["description"].isNotNull() | places["total"].isNotNull()
    return F.when(usable & (F.size(table) >= 2), full).otherwise(F.array().cast(ITEMS))


def line_items(docs: DataFrame) -> DataFrame:
    """``docs`` with line_items: of the first table that has any, else of the text."""
    from_text = text_items(F.col("text"))
    if "tables" not in docs.columns:
        return docs.withColumn("line_items", from_text)
    of_tables = F.filter(F.transform("tables", table_items), lambda x: F.size(x) > 0)
    return docs.withColumn("line_items", F.coalesce(F.get(of_tables, F.lit(0)), from_text))


def item_rows(invoices: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the parts of each item of line_items.

    An outer generator with a filter behind it: before a plain one Spark filters by the size of its array, and so would work
    out all items three times.
    """
    each = invoices.select(*keys, F.posexplode_outer("line_items").alias("__place", "__item"))
    return each.filter("__place is not null").select(*keys, "__item.*")


# Checks.


def cents_apart(a: Column, b: Column) -> Column:
    """The difference of two amounts to a cent, so that a difference at the tolerance is within it."""
    return F.round(F.abs(F.round(a, 2) - b), 2)


def totals_reconcile(subtotal: Column, tax: Column, total: Column) -> Column:
    known = subtotal.isNotNull() & tax.isNotNull() & total.isNotNull()
    return F.when(~known, "skipped").when(cents_apart(subtotal + tax, total) <= TOTAL_TOLERANCE, "passed").otherwise("failed")


def items_sum(items: Column) -> Column:
    return F.round(F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["total"], F.lit(0.0))), 2)


def items_reconcile(n_items: Column, total: Column, subtotal: Column) -> Column:
    return F.when((F.coalesce(n_items, F.lit(0)) == 0) | subtotal.isNull(), "skipped").when(cents_apart(total, subtotal) <= ITEMS_TOLERANCE, "passed").otherwise("failed")


def tax_plausible(subtotal: Column, tax: Column) -> Column:
    rate = F.when(F.coalesce(subtotal > 0, F.lit(False)), F.round(tax / subtotal * 100, 2))
    return bind(rate, lambda x: F.when(x.isNull(), "skipped").when(x.between(0, 30), "passed").otherwise("warning"))


def date_valid(day: Column, today: Column) -> Column:
    parsed = F.try_to_date(day, "yyyy-MM-dd")
    return F.when(parsed.isNull(), "failed").when(parsed > today, "warning").otherwise("passed")


def present(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", "passed").otherwise("failed")


def overall(checks: list[Column]) -> Column:
    every = F.array(*checks)
    return F.when(F.array_contains(every, "failed"), "failed").when(F.array_contains(every, "warning"), "passed_with_warnings").otherwise("passed")


def repeats(invoices: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """``invoices`` with duplicate_check; a number is a repeat after its first invoice in ``order``, or if ``known`` has it."""
    # Invoices without a number are no repeats of each other; they are dealt out by their place instead.
    spread = F.when(F.coalesce("invoice_number", F.lit("")) == "", F.xxhash64(*order))
    nth = F.row_number().over(Window.partitionBy("invoice_number", spread).orderBy(*order))
    marked = invoices.withColumn("__nth", nth)
    again = F.col("__nth") > 1
    if known is not None:
        seen = known.select("invoice_number").distinct().withColumn("__seen", F.lit(True))
        marked = marked.join(seen, "invoice_number", "left")
        again = again | F.col("__seen").isNotNull()
    status = F.when(F.coalesce("invoice_number", F.lit("")) == "", "skipped").when(again, "warning").otherwise("passed")
    return marked.withColumn("duplicate_check", status).drop("__nth", "__seen")


CHECKS = ["invoice_number_present", "date_valid", "vendor_present", "totals_reconcile", "line_items_reconcile", "tax_plausible", "duplicate_check", "field_completeness"]


def validate(invoices: DataFrame, order: list[str], today: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """``invoices`` (of ``fields`` and ``line_items``) with the checks, overall_status, errors, warnings and status."""
    today = F.current_date() if today is None else today
    c = F.col
    total_missing = F.coalesce(c("total"), F.lit(0.0)) == 0
    complete = F.when((c("invoice_number_present") == "failed") | c("invoice_date").isNull() | (c("vendor_present") == "failed") | total_missing, "failed").otherwise("passed")
    found = repeats(invoices, order, known).withColumns({
        "invoice_number_present": present(c("invoice_number")),
        "date_valid": date_valid(c("invoice_date"), today),
        "vendor_present": present(c("vendor.name")),
        "totals_reconcile": totals_reconcile(c("subtotal"), c("tax"), c("total")),
        "line_items_reconcile": items_reconcile(F.size("line_items"), items_sum(c("line_items")), c("subtotal")),
        "tax_plausible": tax_plausible(c("subtotal"), c("tax")),
    })
    found = found.withColumn("field_completeness", complete).withColumn("overall_status", overall([c(n) for n in CHECKS]))
    said = lambda *pairs: F.filter(F.array(*[F.when(condition, F.lit(text)) for condition, text in pairs]), lambda x: x.isNotNull())
    errors = said(
        (c("invoice_number_present") == "failed", "Invoice number could not be extracted"), (c("date_valid") == "failed", "Invoice date could not be extracted"),
        (c("totals_reconcile") == "failed", "Totals do not reconcile"), (c("field_completeness") == "failed", "Missing required fields"),
    )
    warnings = said(
        (c("date_valid") == "warning", "Invoice date is in the future"), (c("vendor_present") == "failed", "Vendor name could not be extracted"),
        (c("totals_reconcile") == "skipped", "Cannot verify totals"), (c("line_items_reconcile") == "failed", "Line items do not match the subtotal"),
        (c("tax_plausible") == "warning", "Tax rate is outside 0-30%"), (c("duplicate_check") == "warning", "Possible duplicate"),
    )
    status = F.when(F.size("errors") > 0, "failed").when(F.size("warnings") > 0, "passed_with_warnings").otherwise("passed")
    return found.withColumns({"errors": errors, "warnings": warnings}).withColumn("status", status)


def process(docs: DataFrame, order: list[str], today: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """Fields, line items and checks of each document."""
    return validate(line_items(fields(docs)), order, today, known)


def summary(invoices: DataFrame, key: str) -> DataFrame:
    """key, field, value: the fields of each invoice as rows."""
    names = ["invoice_number", "invoice_date", "due_date", "vendor.name", "vendor.address", "vendor.tax_id", "buyer.name", "buyer.address", "currency", "subtotal", "tax", "tax_rate_percent", "total"]
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names])
    return invoices.select(key, F.inline(pairs))
